"""Sources and sinks over files made from the driver's tables: what is read back
must be what SQL says of the tables themselves."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import similar
from ..operators import records as op
from ..operators import similarity
from ..sources import sinks, spreadsheet, tables
from ..sources.scratch import fresh_folder
from .registry import query, table
from .text_queries import _SIGNS, signs

#: Customers of one workbook, which an upload's limits bound.
BOOK = 400
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _book(rows: list[tuple[int, list[tuple[str, str, str]]]]) -> bytes:
    """A workbook of (row, [(column, kind, text)]): shared, inline or plain cells."""
    shared = sorted({t for _, cells in rows for _, kind, t in cells if kind == "s"})
    place = {t: i for i, t in enumerate(shared)}
    cell = {"s": lambda at, t: f'<c r="{at}" t="s"><v>{place[t]}</v></c>', "inlineStr": lambda at, t: f'<c r="{at}" t="inlineStr"><is><t>{t}</t></is></c>', "n": lambda at, t: f'<c r="{at}"><v>{t}</v></c>'}
    body = "".join(f'<row r="{r}">' + "".join(cell[kind](f"{col}{r}", t) for col, kind, t in cells) + "</row>" for r, cells in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet3.xml", f"<worksheet {_NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><t>{t}</t></si>" for t in shared) + "</sst>")
    return out.getvalue()


def _workbooks(spark, sf_dir):
    """Cells of workbooks with a path, a text and a number for each customer, BOOK of them each."""

    def make(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(1, [("A", "s", "path"), ("B", "s", "text"), ("D", "s", "balance")])]
        for nth, key, segment in sorted(zip(group["nth"], group["c_custkey"], group["c_mktsegment"], strict=True)):
            own = [("A", "inlineStr", f"/v/{key}" + (".doc" if key % 3 == 0 else ".mp4"))] if key % 5 else []
            own += [("B", "s" if key % 2 else "inlineStr", segment)] if key % 7 else []
            rows.append((int(nth) + 1, [*own, ("D", "n", str(key * 2))]))
        return pd.DataFrame({"path": [f"book{group['book'].iloc[0]}.xlsx"], "content": [_book(rows)]})

    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", f"c_custkey div {BOOK} AS book", f"c_custkey % {BOOK} + 1 AS nth")
    return spreadsheet.parse_workbooks(c.groupBy("book").applyInPandas(make, "path string, content binary"))


_BOOKS = f"b AS (SELECT 'book' || (c_custkey // {BOOK}) || '.xlsx' AS path, CAST(c_custkey % {BOOK} + 2 AS INTEGER) AS row_number, CASE WHEN c_custkey % 5 > 0 THEN '/v/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.doc' ELSE '.mp4' END END AS a, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS b, CAST(c_custkey * 2 AS VARCHAR) AS d FROM customer)"


@query("s01_workbook_rows", f"WITH {_BOOKS} SELECT path, row_number, a AS video_path, b AS text, CASE WHEN a IS NULL THEN 'path_empty' WHEN b IS NULL THEN 'text_empty' WHEN a LIKE '%.doc' THEN 'bad_extension' ELSE 'ok' END AS verdict, coalesce(b, '') AS text_preview FROM b WHERE a IS NOT NULL OR b IS NOT NULL")
def workbook_rows(spark, sf_dir):
    return spreadsheet.task_rows(_workbooks(spark, sf_dir).where("error IS NULL"))


@query("s03_workbook_guards", "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE c_custkey % 4 WHEN 1 THEN 'not a workbook' WHEN 2 THEN 'workbook unpacks to more than the limits' WHEN 3 THEN 'a workbook without sheets' END AS error FROM customer")
def workbook_guards(spark, sf_dir):
    """Files that are workbooks, no archives, archives of too many entries, and archives without sheets."""

    def make(key: pd.Series) -> pd.Series:
        good, many, bare = _book([(1, [("A", "s", "x")])]), io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(many, "w") as z:
            for i in range(spreadsheet.MOST_ENTRIES + 1):
                z.writestr(str(i), "")
        with zipfile.ZipFile(bare, "w") as z:
            z.writestr("mimetype", "x")
        kinds = [good, b"no archive", many.getvalue(), bare.getvalue()]
        return key.map(lambda k: kinds[k % 4])

    content = F.pandas_udf(make, "binary")
    # A customer's few bytes become a file: the rows of one small input are many tasks' work.
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    files = keys.select(F.col("c_custkey").cast("string").alias("path"), content("c_custkey").alias("content"))
    return spreadsheet.parse_workbooks(files).select("path", "error")


@query("s04_sheet_column", f"WITH {_BOOKS} SELECT path, row_number, b AS value FROM b WHERE b IS NOT NULL UNION ALL SELECT DISTINCT path, 1, 'text' FROM b")
def sheet_column(spark, sf_dir):
    return spreadsheet.column(_workbooks(spark, sf_dir), "B")


@query("s05_cell_texts", f"WITH {_BOOKS}, x AS (SELECT path, row_number, unnest(['A', 'B', 'D']) AS col, unnest([a, b, d]) AS value FROM b UNION ALL SELECT path, 1, unnest(['A', 'B', 'D']), unnest(['path', 'text', 'balance']) FROM (SELECT DISTINCT path FROM b)) SELECT path, row_number, col, value FROM x WHERE value IS NOT NULL")
def cell_texts(spark, sf_dir):
    return _workbooks(spark, sf_dir).select("path", "row_number", "col", "value")


@query("s06_sheet_records", f"WITH {_BOOKS} SELECT path, row_number, a AS shot, b AS line, d AS balance FROM b")
def sheet_records(spark, sf_dir):
    r = tables.sheet_records(_workbooks(spark, sf_dir))
    return r.select("path", "row_number", F.try_element_at("fields", F.lit("path")).alias("shot"), F.try_element_at("fields", F.lit("text")).alias("line"), F.try_element_at("fields", F.lit("balance")).alias("balance"))


@query("s06_storyboard_records", "SELECT p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_name END AS line FROM part WHERE p_size % 4 > 0")
def storyboard_records(spark, sf_dir):
    """A CSV storyboard with blank rows, read as maps."""
    at = fresh_folder(spark)
    p = table(spark, sf_dir, "part").selectExpr("CASE WHEN p_size % 4 > 0 THEN CAST(p_partkey AS STRING) ELSE ' ' END AS shot", "CASE WHEN p_size % 4 > 0 AND p_size % 3 > 0 THEN p_name ELSE '' END AS line")
    sinks.write_csv(p, at)
    r = tables.records(tables.read_strings(spark, at))
    return r.select(F.try_element_at("fields", F.lit("shot")).cast("long").alias("id"), F.try_element_at("fields", F.lit("line")).alias("line"))


@query("s07_labelled_rows", "SELECT 'queue' AS label, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 6 = 0 THEN 'parse_failed' END AS problem FROM supplier UNION ALL SELECT 'report', NULL, 'missing'")
def labelled_rows(spark, sf_dir):
    """A table with some lines of too many fields, and one that isn't there."""
    at = fresh_folder(spark)
    lines = table(spark, sf_dir, "supplier").selectExpr("concat(s_suppkey, ',', s_nationkey, CASE WHEN s_suppkey % 6 = 0 THEN ',more,fields' ELSE '' END) AS `id,nation`")
    lines.write.option("header", True).option("sep", "\x01").csv(at)  # one column, named by the header line that each file has
    r = tables.read_labelled(spark, {"queue": at, "report": at + "-none"})
    return r.select("label", F.try_element_at("fields", F.lit("id")).alias("id"), "problem")


@query("s11_timings", "SELECT CAST(l_orderkey * 10 + l_linenumber AS INTEGER) AS \"index\", CAST(l_quantity AS DOUBLE) / 4 AS duration FROM lineitem")
def timings(spark, sf_dir):
    at = fresh_folder(spark)
    sinks.write_csv(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS index", "CAST(l_quantity AS DOUBLE) / 4 AS duration", "'x' AS text"), at)
    return tables.read_timings(spark, at)


@query("s13_inventory", "SELECT 'region' AS role, '.txt' AS suffix, CAST(sum(length(n_name) + 1) AS BIGINT) AS bytes, sha1(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS sha1 FROM nation GROUP BY n_regionkey")
def inventory(spark, sf_dir):
    """A text file for each region, listed with digests."""
    at = fresh_folder(spark)
    table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).repartition("n_regionkey").sortWithinPartitions("n_regionkey", "value").write.partitionBy("n_regionkey").text(at)
    return tables.inventory(spark, at, (".txt",), with_hash=True, role="region").select("role", "suffix", "bytes", "sha1")


@query("s14_snapshot_list", "SELECT 'list' AS snapshot, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def snapshot_list(spark, sf_dir):
    """A snapshot that is a list, and one that isn't."""
    at = fresh_folder(spark)
    rows = table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))).alias("value"))
    rows.write.text(at + "/list")
    rows.select(F.concat(F.lit('{"nations": '), "value", F.lit("}")).alias("value")).write.text(at + "/object")
    read = lambda kind: tables.read_list(spark, f"{at}/{kind}", "id: bigint, name: string").select(F.lit(kind).alias("snapshot"), "id", "name")
    return read("list").unionByName(read("object"))


@query("s15_extended_lexicon", "SELECT DISTINCT category, word FROM (SELECT p_brand AS category, p_type AS word FROM part UNION ALL SELECT p_brand, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN p_type ELSE p_name END FROM part) WHERE word <> ''")
def extended_lexicon(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    extra = p.selectExpr("p_brand AS category", "CASE WHEN p_size % 5 = 0 THEN ' ' WHEN p_size % 2 = 0 THEN concat('\\t', p_type, '\\n') ELSE concat(' ', p_name) END AS word")
    return op.extended_lexicon(p.selectExpr("p_brand AS category", "p_type AS word"), extra)


@query("k04_appended_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def appended_csv(spark, sf_dir):
    """Two appends of records, read back as one table."""
    at = fresh_folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")):
        sinks.append_csv(part, at, ["event_id", "event_type"])
    return tables.read_strings(spark, at)


_LEVELS = "1 - hamming(l.bits, r.bits) / 64 AS similarity, CASE WHEN 1 - hamming(l.bits, r.bits) / 64 >= 0.75 THEN 'high' WHEN 1 - hamming(l.bits, r.bits) / 64 >= 0.65 THEN 'medium' ELSE 'low' END AS level FROM s l JOIN s r ON l.label = r.label AND l.vec_id < r.vec_id"


def _pairs(spark, sf_dir):
    p = similarity.exhaustive_scores(signs(spark, sf_dir), "vec_id", "label", "hash", similarity.hash_scores)
    return p.withColumn("level", similar.level(F.col("similarity"), 0.75, 0.65))


@query("k06_similarity_report", f"WITH {_SIGNS}, p AS (SELECT {_LEVELS}) SELECT 0.75::DOUBLE AS threshold, (SELECT count(*) FROM s) AS videos, (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM p WHERE level = 'high') AS high_similarity, 'ValueError: no sound' AS audio_error")
def similarity_report(spark, sf_dir):
    """A report whose sound fails, written and read back."""

    def sound():
        raise ValueError("no sound")

    at = fresh_folder(spark)
    sinks.write_similarity_report(signs(spark, sf_dir), _pairs(spark, sf_dir), at, 0.75, sound)
    return spark.read.schema("threshold double, videos long, pairs long, high_similarity long, audio_error string").json(f"{at}/summary.json")


@query("k06_report_top", f"WITH {_SIGNS}, p AS (SELECT l.vec_id AS left_id, r.vec_id AS right_id, {_LEVELS}) SELECT * FROM p ORDER BY similarity DESC, left_id, right_id LIMIT 80")
def report_top(spark, sf_dir):
    return sinks.top_pairs(_pairs(spark, sf_dir))


@query("k07_reused_selections", "WITH f AS (SELECT p_partkey FROM part WHERE p_size > 2), g AS (SELECT l_orderkey FROM lineitem LEFT JOIN f ON p_partkey = l_partkey GROUP BY l_orderkey HAVING count(*) = l_orderkey % 7 + 1 AND count(*) FILTER (WHERE p_partkey IS NULL) = 0) SELECT l_orderkey, l_linenumber AS \"index\", 'part' || l_partkey AS file FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM g)")
def reused_selections(spark, sf_dir):
    saved = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber AS index", "concat('part', l_partkey) AS file")
    lines = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderkey % 7 + 1 AS lines")
    files = table(spark, sf_dir, "part").where("p_size > 2").selectExpr("concat('part', p_partkey) AS file")
    return sinks.reusable_selections(saved, lines, files, "l_orderkey").select("l_orderkey", "index", "file")


def _production(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    copies = o.selectExpr("concat('/ready/', o_orderkey, '.mp4') AS file", "concat('/review/batch', o_custkey, '/', o_orderkey, '.mp4') AS original", "o_orderpriority AS dedup_level", "o_orderstatus AS similarity_status", "CAST(o_orderkey % 9 AS STRING) AS account_slot", "CASE WHEN o_orderkey % 4 > 0 THEN concat('/src/', o_custkey) END AS source", "CASE WHEN o_orderkey % 5 > 0 THEN concat('b', o_custkey) END AS batch_id", "'thin' AS dedup_border_style", "CASE WHEN o_orderkey % 2 = 0 THEN '0.5' END AS dedup_intro_trim", "'0.25' AS dedup_outro_trim")
    return sinks.production_table(copies)


_PRODUCTION = "p AS (SELECT CAST(o_orderkey % 9 AS VARCHAR) AS account_slot, '/ready/' || o_orderkey || '.mp4' AS file, CASE WHEN o_orderkey % 4 > 0 THEN '/src/' || o_custkey ELSE '/review/batch' || o_custkey || '/' || o_orderkey || '.mp4' END AS source, CASE WHEN o_orderkey % 5 > 0 THEN 'b' || o_custkey ELSE 'batch' || o_custkey END AS batch_id, o_orderpriority AS dedup_level, o_orderstatus AS similarity_status, 'thin' AS variant_border, '' AS variant_zoom, '' AS variant_speed, CASE WHEN o_orderkey % 2 = 0 THEN '0.5' ELSE '' END || '/0.25' AS variant_trim, '/review/batch' || o_custkey || '/' || o_orderkey || '.mp4' AS original_file FROM orders)"


@query("k10_production_list", f"WITH {_PRODUCTION} SELECT * FROM p")
def production_list(spark, sf_dir):
    return _production(spark, sf_dir)


@query("k10_feedback_template", f"WITH {_PRODUCTION} SELECT account_slot, regexp_extract(file, '([^/]*)$', 1) AS file, source, batch_id, dedup_level, similarity_status, '' AS platform, '' AS publish_status, '' AS publish_time, '' AS publish_url, '' AS play_count, '' AS duplicate_flag, '' AS fail_reason, '' AS note FROM p")
def feedback_template(spark, sf_dir):
    return sinks.feedback_template(_production(spark, sf_dir))


@query("k10_cut_plan", "SELECT user_id AS plan, printf('S%03d', row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id)) AS \"镜号\", event_type AS \"素材文件\", printf('%.3f', CAST(event_id AS DOUBLE)) AS \"开始秒\", printf('%.3f', event_id % 40 / 8.0::DOUBLE) AS \"时长\", '' AS \"人物\", '原声/待配音' AS \"声音类型\", CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS \"台词\", 'e' || event_id AS \"备注\" FROM events")
def cut_plan(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("user_id AS plan", "event_type AS source", "event_id AS start", "event_id % 40 / 8.0D AS duration", "CASE WHEN event_id % 2 = 0 THEN event_type END AS text", "concat('e', event_id) AS reason")
    return sinks.cut_plan(s, "plan")


@query("k10_inventory_table", "SELECT 'clips' AS role, '/in/' || p_partkey || '.MP4' AS path, p_partkey || '.MP4' AS name, '.mp4' AS suffix, round_even(p_partkey * 1000 / 1048576::DOUBLE, 3) AS size_mb, '2024-01-02T03:04:05' AS modified_at, '' AS sha1 FROM part")
def inventory_table(spark, sf_dir):
    files = table(spark, sf_dir, "part").selectExpr("'clips' AS role", "concat('/in/', p_partkey, '.MP4') AS path", "concat(p_partkey, '.MP4') AS name", "'.mp4' AS suffix", "bround(p_partkey * 1000 / 1048576D, 3) AS size_mb", "TIMESTAMP_NTZ '2024-01-02 03:04:05.678' AS modified", "'' AS sha1")
    return sinks.inventory_table(files)


@query("k12_report_triplet", "WITH r AS (SELECT 'v' || p_partkey AS video_path, printf('%.2f', CAST(p_size AS DOUBLE) / 4) AS second, p_name AS note FROM part) SELECT 'csv' AS form, video_path || ' ' || second AS row FROM r UNION ALL SELECT 'json', video_path || ' ' || second FROM r UNION ALL SELECT 'md', '| ' || video_path || ' | ' || second || ' | ' || note || ' |' FROM r")
def report_triplet(spark, sf_dir):
    """One report in its three forms, each read back."""
    at = fresh_folder(spark)
    r = table(spark, sf_dir, "part").select(F.concat(F.lit("v"), "p_partkey").alias("video_path"), F.format_string("%.2f", F.col("p_size").cast("double") / 4).alias("second"), F.col("p_name").alias("note"))
    sinks.write_triplet(r, at, "covers", ["video_path", "second", "note"])
    both = F.concat_ws(" ", "video_path", "second").alias("row")
    csv = tables.read_strings(spark, f"{at}/covers.csv").select(F.lit("csv").alias("form"), both)
    json = spark.read.schema("video_path string, second string").json(f"{at}/covers.json").select(F.lit("json").alias("form"), both)
    return csv.unionByName(json).unionByName(spark.read.text(f"{at}/covers.md").select(F.lit("md").alias("form"), F.col("value").alias("row")))
