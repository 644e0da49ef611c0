"""Record, listing and session operators: orders as outputs, customers as accounts,
events as logs, documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similar
from ..operators import ledger as lg
from ..operators import matching as mt
from ..operators import records as op
from ..operators import timeline as tl
from .feedback_queries import RECORDS, latest, records
from .ledger_queries import LEDGER, ledger
from .registry import query, table
from .text_queries import _COSINE, _bits, _words
from .timeline_queries import SPANS, events, lines, spans

FILES_SQL = "files AS (SELECT doc_id, 'root/' || source || '/' || lang || '/' || doc_id || '.txt' AS path, n_chars FROM documents)"


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('root/', source, '/', lang, '/', doc_id, '.txt')").alias("path"), "n_chars")


def orders(spark, sf_dir, *columns):
    return table(spark, sf_dir, "orders").select(*[F.expr(c) for c in columns])


# --- predicates


@query("f07_release_blocks", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 50 <= 10 THEN 'too_short' END AS blocked FROM orders")
def release_blocks(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderkey", "CASE WHEN o_orderkey % 10 > 0 THEN (o_orderkey % 50) / 10 END AS seconds")
    return o.select("o_orderkey", op.release_block(F.col("seconds")).alias("blocked"))


@query("f08_paused_batches", "SELECT c_custkey AS batch_id FROM customer WHERE c_custkey % 7 = 0")
def paused_batches(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("c_custkey AS batch_id", "CAST(c_custkey % 7 = 0 AS INT) AS paused").where("paused = 1").select("batch_id")


@query("f09_next_actionable", "WITH i AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events) SELECT user_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY idx < user_id % 10, idx) AS k FROM i WHERE event_type = 'error') WHERE k = 1")
def next_actionable(spark, sf_dir):
    i = table(spark, sf_dir, "events").selectExpr("user_id", "event_type", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS idx")
    return op.next_actionable(i, "user_id", "idx", F.expr("user_id % 10"), F.col("event_type") == "error")


@query("f11_manifest_report", "SELECT count(*) AS n, count(*) FILTER (WHERE p_size % 3 = 0) AS unfilled, 'audio_file' AS missing FROM part")
def manifest_report(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS index", "CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END AS file", "CAST(NULL AS STRING) AS path")
    return op.manifest_report(p, ["index", "audio_file"], ["file", "path", "sound"])


@query("f12_valid_ladders", "WITH s AS (SELECT p_partkey // 3 AS machine, list_sort(list_distinct(list(p_size % 20))) AS steps FROM part GROUP BY 1) SELECT machine, CASE WHEN len(list_filter(steps, lambda x: x < 1 OR x > 16)) = 0 THEN array_to_string(steps, ',') END AS ladder FROM s")
def valid_ladders(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 3").alias("machine")).agg(F.collect_list(F.expr("p_size % 20")).alias("steps"))
    return s.select("machine", F.array_join(op.valid_ladder(F.col("steps")), ",").alias("ladder"))


# --- joins


@query("j03_leader_results", LEDGER + "SELECT f.task_id, l.status AS leader_status, l.output_path FROM ledger f JOIN ledger l ON l.task_id = f.leader_task_id WHERE f.status = 'waiting_dependency' AND l.status = 'completed'")
def leader_results(spark, sf_dir):
    led = ledger(spark, sf_dir)
    done = led.where("status = 'completed'").select(F.col("task_id").alias("leader_task_id"), F.col("status").alias("leader_status"), "output_path")
    return led.where("status = 'waiting_dependency'").select("task_id", "leader_task_id").join(done, "leader_task_id").drop("leader_task_id")


@query("j13_match_by_name", "WITH m AS (SELECT lower('Clip_' || (o_orderkey % 300) || '.mp4') AS name, min(o_orderkey) AS ord FROM orders GROUP BY 1) SELECT event_id, ord FROM events LEFT JOIN m ON name = 'clip_' || (event_id % 400) || '.mp4'")
def match_by_name(spark, sf_dir):
    m = orders(spark, sf_dir, "o_orderkey AS ord", "o_orderkey AS first", "concat('/out/', o_orderkey, '/Clip_', o_orderkey % 300, '.mp4') AS path")
    e = table(spark, sf_dir, "events").selectExpr("event_id", "concat('C:\\\\in\\\\CLIP_', event_id % 400, '.mp4') AS file")
    found = mt.prioritised_match(e, m, "event_id", "ord", [(F.col("file"), F.col("path")), (op.basename(F.col("file")), op.basename(F.col("path")))], ["first"])
    return found.select("event_id", F.col("first").alias("ord"))


@query("j16_session_items", "SELECT o_orderkey, coalesce(n_name, 'none') AS platform, coalesce('c' || c_custkey, 'untitled') AS caption, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' ELSE 'pending' END AS status FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 40 LEFT JOIN customer ON c_custkey = o_orderkey")
def session_items(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderkey", "CAST(o_custkey % 40 AS INT) AS n_nationkey", "o_orderkey AS c_custkey")
    there = orders(spark, sf_dir, "o_orderkey", "true AS there").where("o_orderkey % 9 > 0")
    joined = o.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "left").join(table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('c', c_custkey) AS caption"), "c_custkey", "left").join(there, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("n_name", F.lit("none")).alias("platform"), F.coalesce("caption", F.lit("untitled")).alias("caption"), F.when(F.col("there"), "pending").otherwise("missing").alias("status"))


_CONTAINED = """WITH t AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_suppkey || 'x' ELSE CAST(s_suppkey % 40 AS VARCHAR) END AS token FROM supplier), n AS (SELECT c_custkey, 'v' || c_custkey || 'x' AS name FROM customer)
SELECT token, name FROM (SELECT token, name, row_number() OVER (PARTITION BY token ORDER BY name IS DISTINCT FROM token, c_custkey) AS k FROM t LEFT JOIN n ON contains(name, token)) WHERE k = 1"""


@query("j20_contained_names", _CONTAINED)
def contained_names(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").selectExpr("CASE WHEN s_suppkey % 3 = 0 THEN concat('v', s_suppkey, 'x') ELSE CAST(s_suppkey % 40 AS STRING) END AS token").distinct()
    n = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('v', c_custkey, 'x') AS name")
    return op.match_contained(t, n, "token", "name", "c_custkey")


@query("j21_batch_records", RECORDS + "SELECT seq, file, import_id FROM latest WHERE import_id = 'imp007' OR file IN (SELECT 'clip_' || s_suppkey || '.mp4' FROM supplier)")
def batch_records(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").selectExpr("concat('clip_', s_suppkey, '.mp4') AS file")
    return op.records_of(latest(spark, sf_dir), "seq", F.col("import_id") == "imp007", own, "file").select("seq", "file", "import_id")


@query("j22_release_status", "WITH l AS (SELECT event_id % 3000 AS id, arg_max(event_type, event_id) AS a FROM events GROUP BY 1) SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'rejected' WHEN o_orderkey % 4 = 0 THEN 'ready' ELSE coalesce(a, 'unknown') END AS status FROM orders LEFT JOIN l ON l.id = o_orderkey")
def release_status(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderkey AS id")
    log = table(spark, sf_dir, "events").selectExpr("event_id % 3000 AS id", "event_type AS action", "event_id AS seq")
    return op.release_status(o, [("ready", o.where("id % 4 = 0")), ("rejected", o.where("id % 10 = 0"))], log, "id", "seq")


@query("j24_rework_batches", "SELECT o_orderkey AS report FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey IN (SELECT s_suppkey FROM supplier)")
def rework_batches(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderkey AS report", "o_orderpriority AS path", "o_custkey AS name")
    return op.records_of(o, "report", F.col("path") == "1-URGENT", table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS name"), "name").select("report")


@query("j29_traces", "WITH m AS (SELECT o_orderkey % 500 AS k, min(o_orderkey) AS manifest FROM orders GROUP BY 1), f AS (SELECT event_id % 700 AS k, arg_min(event_type, event_id) AS feedback FROM events GROUP BY 1) SELECT c_custkey, manifest, feedback FROM customer LEFT JOIN m ON m.k = c_custkey LEFT JOIN f ON f.k = c_custkey")
def traces(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('/out/V', c_custkey, '.MP4') AS path")
    m = orders(spark, sf_dir, "o_orderkey AS seq", "o_orderkey AS value", "concat('v', o_orderkey % 500, '.mp4') AS file")
    e = table(spark, sf_dir, "events").selectExpr("event_id AS seq", "event_type AS value", "concat('d:\\\\x\\\\v', event_id % 700, '.mp4') AS file")
    return op.trace(c, "path", {"manifest": (m, "file", "value", "seq"), "feedback": (e, "file", "value", "seq")}).drop("path")


@query("j30_reassigned_slots", "WITH s AS (SELECT o_custkey % 9 AS batch, 'A' || o_orderkey AS slot, row_number() OVER (PARTITION BY o_custkey % 9 ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 13 = 0), r AS (SELECT c_custkey % 9 AS batch, c_custkey AS item, row_number() OVER (PARTITION BY c_custkey % 9 ORDER BY c_custkey) AS place FROM customer WHERE c_nationkey = 3) SELECT batch, place, slot, item FROM s JOIN r USING (batch, place)")
def reassigned_slots(spark, sf_dir):
    o = orders(spark, sf_dir, "o_custkey % 9 AS batch", "o_orderkey", "concat('A', o_orderkey) AS slot")
    flagged = orders(spark, sf_dir, "o_orderkey").where("o_orderkey % 13 = 0")
    slots = o.join(flagged, "o_orderkey", "left_semi").select("batch", "o_orderkey", "slot")
    fresh = table(spark, sf_dir, "customer").where("c_nationkey = 3").selectExpr("c_custkey % 9 AS batch", "c_custkey AS item")
    return tl.zip_rows(slots, fresh, "batch", "o_orderkey", "item").where("slot IS NOT NULL AND item IS NOT NULL").select("batch", F.col("place").cast("long").alias("place"), "slot", "item")


@query("j30_account_slots", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'left' WHEN c_custkey % 4 = 1 THEN 'left,right' WHEN c_custkey % 4 = 2 THEN 'left,right,A03' ELSE 'left,right,A03,A04' END AS slots FROM customer")
def account_slots(spark, sf_dir):
    slots = op.account_slots(F.expr("CAST(c_custkey % 4 + 1 AS INT)"), ["left", "right"])
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(slots, ",").alias("slots"))


_RESOLVE = """WITH l AS (SELECT '/r' || (o_custkey % 3) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/d' || (o_custkey % 7) END || '/v' || (o_orderkey % 200) || '.mp4' AS path, o_custkey % 3 AS root, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS depth, 'v' || (o_orderkey % 200) || '.mp4' AS name FROM orders),
w AS (SELECT DISTINCT CASE WHEN event_id % 5 = 0 THEN '/r1/d2/v' || (event_id % 250) || '.mp4' ELSE 'v' || (event_id % 250) || '.mp4' END AS value FROM events),
c AS (SELECT value, path, CASE WHEN path = value THEN 0 WHEN depth = 1 THEN 1 ELSE 2 END AS kind, root FROM w LEFT JOIN l ON name = split_part(value, '/', -1))
SELECT value, path FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY kind, CASE WHEN kind = 1 THEN root ELSE 0 END, length(path), path) AS k FROM c) WHERE k = 1"""


@query("j31_resolved_paths", _RESOLVE)
def resolved_paths(spark, sf_dir):
    listing = orders(spark, sf_dir, "concat('/r', o_custkey % 3, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('/d', o_custkey % 7) END, '/v', o_orderkey % 200, '.mp4') AS path", "o_custkey % 3 AS root", "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS depth")
    wanted = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 5 = 0 THEN concat('/r1/d2/v', event_id % 250, '.mp4') ELSE concat('v', event_id % 250, '.mp4') END AS value").distinct()
    return op.resolve_paths(wanted, listing, "value")


# --- listings and sources


@query("a19_files_in_folders", f"WITH {FILES_SQL} SELECT split_part(path, '/', 2) AS folder, count(*) AS n FROM files GROUP BY 1")
def files_in_folders(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("folder")).agg(F.count("*").alias("n"))


@query("a22_folder_sizes", f"WITH {FILES_SQL}, d AS (SELECT 'root' AS dir, n_chars FROM files UNION ALL SELECT 'root/' || split_part(path, '/', 2), n_chars FROM files UNION ALL SELECT 'root/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3), n_chars FROM files) SELECT dir, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM d GROUP BY dir")
def folder_sizes(spark, sf_dir):
    return op.dir_totals(files(spark, sf_dir), "path", "n_chars")


@query("a21_names_by_category", "SELECT p_type, list(DISTINCT p_brand ORDER BY p_brand) AS names FROM part GROUP BY p_type")
def names_by_category(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("names"))


@query("s12_media_order", f"WITH {FILES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY lower(split_part(path, '/', 3)), lower(split_part(path, '/', 4))) AS nth FROM files")
def media_order(spark, sf_dir):
    nth = "row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY lower(split_part(path, '/', 3)), lower(split_part(path, '/', 4)))"
    return files(spark, sf_dir).selectExpr("doc_id", f"CAST({nth} AS BIGINT) AS nth")


@query("s16_accounts", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'main' ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 4 = 0 THEN '1' ELSE '2' END AS publish_count FROM customer WHERE c_custkey % 5 <> 1")
def account_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS name", "CASE WHEN c_custkey % 4 > 0 THEN '2' END AS publish_count", "CASE c_custkey % 5 WHEN 1 THEN 'No' WHEN 2 THEN 'YES' WHEN 3 THEN '' END AS enabled")
    return op.accounts(c, {"name": "main", "publish_count": 1}, "enabled").drop("enabled")


@query("s18_audio_entries", "SELECT conv_id, turn, coalesce(CASE WHEN turn % 2 = 0 THEN turn * 10 END, row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS index FROM conversations")
def audio_entries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "coalesce(CASE WHEN turn % 2 = 0 THEN turn * 10 END, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT)) AS index")


@query("s19_plan_items", "SELECT user_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id END, row_number() OVER (PARTITION BY user_id ORDER BY event_id)) AS nth, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id % 50 AS DOUBLE) END AS start, CASE WHEN event_id % 5 = 0 THEN 0.3 WHEN event_id % 4 = 0 THEN event_id % 50 + 1.0 ELSE 1.0 END::DOUBLE AS duration FROM events")
def plan_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "CASE WHEN event_id % 3 = 0 THEN event_id END AS order", "CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 50 AS DOUBLE) END AS start", "CASE WHEN event_id % 5 > 0 THEN event_id % 50 + 1.0D END AS end")
    return op.plan_items(e, "user_id", "event_id")


@query("s20_packaged_sources", "WITH m AS (SELECT user_id AS manifest, '/out/' || (event_id % 300) || '.mp4' AS path, event_id AS seq FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY manifest DESC, seq) AS k FROM m) SELECT path, manifest, seq, coalesce(c_name, 'untitled') AS title FROM f LEFT JOIN customer ON c_custkey = seq WHERE k = 1 AND path IN (SELECT '/out/' || o_orderkey || '.mp4' FROM orders)")
def packaged_sources(spark, sf_dir):
    m = table(spark, sf_dir, "events").selectExpr("user_id AS manifest", "concat('/out/', event_id % 300, '.mp4') AS path", "event_id AS seq")
    there = orders(spark, sf_dir, "concat('/out/', o_orderkey, '.mp4') AS path")
    first = m.join(there, "path", "left_semi").groupBy("path").agg(F.min_by(F.struct("manifest", "seq"), F.struct(-F.col("manifest"), "seq")).alias("r")).select("path", "r.*")
    titles = table(spark, sf_dir, "customer").selectExpr("c_custkey AS seq", "c_name AS title")
    return first.join(titles, "seq", "left").select("path", "manifest", "seq", F.coalesce("title", F.lit("untitled")).alias("title"))


@query("s21_platform_maps", "SELECT user_id AS slot, arg_min(event_type, event_id) AS platform, CASE WHEN arg_min(event_type, event_id) = 'click' THEN 'own/click' WHEN arg_min(event_type, event_id) = 'view' AND user_id % 2 = 0 THEN 'own/even' ELSE 'https://' || arg_min(event_type, event_id) END AS entrance FROM events GROUP BY user_id")
def platform_maps(spark, sf_dir):
    kinds = ("click", "view", "purchase", "signup", "error")
    first = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("slot")).agg(F.min_by("event_type", "event_id").alias("platform"))
    own = F.expr("CASE WHEN slot % 2 = 0 THEN map('click', 'own/click', 'view', 'own/even') ELSE map('click', 'own/click') END")
    entrances = op.with_overrides({k: f"https://{k}" for k in kinds}, own)
    return first.select("slot", "platform", F.coalesce(F.try_element_at(entrances, F.col("platform")), F.concat(F.lit("https://"), "platform")).alias("entrance"))


@query("s22_newest_report", "WITH r AS (SELECT o_custkey AS batch, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS kind, o_orderdate AS modified, o_orderkey AS path FROM orders) SELECT batch, path FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY kind, modified DESC, path DESC) AS k FROM r) WHERE k = 1")
def newest_report(spark, sf_dir):
    r = orders(spark, sf_dir, "o_custkey AS batch", "CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS kind", "o_orderdate AS modified", "o_orderkey AS path")
    return r.groupBy("batch").agg(F.max_by("path", F.struct(-F.col("kind"), F.col("modified"), F.col("path"))).alias("path"))


@query("r10_newest_artifact", "SELECT batch, path FROM (SELECT o_custkey AS batch, o_orderkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def newest_artifact(spark, sf_dir):
    from ..sources import tables

    return tables.newest(orders(spark, sf_dir, "o_custkey AS batch", "o_orderdate AS modified", "o_orderkey AS path"), ["batch"]).select("batch", "path")


@query("s24_manifest_fields", "SELECT event_id, CAST(coalesce(json_extract(props, '$.k'), '-1') AS BIGINT) AS k, 'none' AS title FROM events")
def manifest_fields(spark, sf_dir):
    p = F.from_json("props", "k long, title string")
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", F.coalesce("p.k", F.lit(-1).cast("long")).alias("k"), F.coalesce("p.title", F.lit("none")).alias("title"))


@query("k02_timing_table", 'SELECT conv_id, turn, (e - length(text)) / 1000 AS start, e / 1000 AS "end" FROM (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e FROM conversations)')
def timing_table(spark, sf_dir):
    t = tl.prefix_timeline(lines(spark, sf_dir), "conv_id", "turn", "duration")
    return t.select("conv_id", "turn", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"))


@query("k13_flat_manifest", "SELECT o_custkey AS source, 'v' || o_orderstatus AS version, o_orderkey AS segment, '{\"a\":' || (o_orderkey % 3) || ',\"b\":\"' || o_orderpriority || '\"}' AS variant FROM orders")
def flat_manifest(spark, sf_dir):
    o = orders(spark, sf_dir, "o_custkey AS source", "o_orderstatus", "struct(o_orderkey AS segment, o_orderkey % 3 AS a, o_orderpriority AS b) AS s")
    nested = o.groupBy("source", "o_orderstatus").agg(F.collect_list("s").alias("segments")).groupBy("source").agg(F.collect_list(F.struct("o_orderstatus", "segments")).alias("versions"))
    flat = nested.select("source", F.explode("versions").alias("v")).select("source", F.concat(F.lit("v"), "v.o_orderstatus").alias("version"), F.explode("v.segments").alias("s"))
    return flat.select("source", "version", F.col("s.segment").alias("segment"), F.to_json(F.struct("s.a", "s.b")).alias("variant"))


# --- ordered rows


@query("t09_edge_cuts", "WITH n AS (SELECT user_id, event_id, value > 30 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE v), i AS (SELECT user_id, min(event_id) AS f, max(event_id) AS l FROM r GROUP BY user_id, g HAVING count(*) >= 2), w AS (SELECT *, f - lag(l) OVER (PARTITION BY user_id ORDER BY f) AS rest FROM i) SELECT user_id, min(f) AS head, max(l) AS tail, max(rest) AS gap FROM w GROUP BY user_id")
def edge_cuts(spark, sf_dir):
    return op.edge_cuts(tl.islands(events(spark, sf_dir), "user_id", "event_id", F.col("value") > 30), "user_id", 2)


@query("t11_loudness", "SELECT user_id, event_id // 16 AS bin, CAST(sum(floor(value) * floor(value)) AS BIGINT) AS power, count(*) AS n FROM events GROUP BY 1, 2")
def loudness(spark, sf_dir):
    v = F.floor("value").cast("long")
    return table(spark, sf_dir, "events").groupBy("user_id", F.expr("event_id div 16").alias("bin")).agg(F.sum(v * v).alias("power"), F.count("*").alias("n"))


@query("t16_open_tasks", "SELECT o_custkey, count(*) AS total, count(e.id) AS done FROM orders LEFT JOIN (SELECT DISTINCT event_id AS id FROM events WHERE event_type = 'purchase') e ON e.id = o_orderkey GROUP BY o_custkey")
def open_tasks(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("event_id AS o_orderkey", "1 AS d").distinct()
    return orders(spark, sf_dir, "o_orderkey", "o_custkey").join(done, "o_orderkey", "left").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count("d").alias("done"))


@query("t18_shuffled_picks", "WITH f AS (SELECT c_nationkey AS g, c_custkey AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('5|' || c_nationkey || '|' || c_custkey), c_custkey) AS at, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer), l AS (SELECT o_custkey % 25 AS g, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS k FROM orders) SELECT o_orderkey, file FROM l JOIN f ON f.g = l.g AND f.at = (l.k - 1) % f.n + 1")
def shuffled_picks(spark, sf_dir):
    f = table(spark, sf_dir, "customer").selectExpr("CAST(c_nationkey AS BIGINT) AS g", "c_custkey AS file")
    return op.shuffled_pick(orders(spark, sf_dir, "o_custkey % 25 AS g", "o_orderkey"), f, "g", "o_orderkey", "file", 5).select("o_orderkey", "file")


@query("t19_redubbed", "SELECT conv_id, CAST(sum(CASE WHEN turn = 1 THEN 77 ELSE length(text) END) AS BIGINT) AS total FROM conversations GROUP BY conv_id")
def redubbed(spark, sf_dir):
    l = lines(spark, sf_dir)
    fresh = l.where("turn = 1").select("conv_id", "turn", F.lit(77).cast("long").alias("duration"))
    merged = l.join(fresh.withColumnRenamed("duration", "new"), ["conv_id", "turn"], "left").withColumn("duration", F.coalesce("new", "duration"))
    return merged.groupBy("conv_id").agg(F.sum("duration").alias("total"))


@query("r06_changed_after", LEDGER + "SELECT task_id, updated_at FROM ledger WHERE updated_at > 860000000 ORDER BY updated_at, task_id LIMIT 300")
def changed_after(spark, sf_dir):
    return ledger(spark, sf_dir).where("updated_at > 860000000").orderBy("updated_at", "task_id").limit(300).select("task_id", "updated_at")


_CHUNKS = f"""WITH {SPANS}, c AS (SELECT user_id, s."start" + k * 120 AS a, least(s."start" + (k + 1) * 120, s."end") AS b FROM spans s, unnest(range(5)) t(k) WHERE s."start" + k * 120 < s."end"),
d AS (SELECT user_id, a AS "start", b - a AS duration FROM c WHERE b - a >= 0.35), p AS (SELECT *, coalesce(sum(duration) OVER (PARTITION BY user_id ORDER BY "start", duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT user_id, count(*) AS n, sum(least(duration, 600 - before)) AS taken FROM p WHERE before < 600 GROUP BY user_id"""


@query("r11_chunks_to_budget", _CHUNKS)
def chunks_to_budget(spark, sf_dir):
    cut = tl.split_long(spans(spark, sf_dir), 120.0, 0.35)
    cut = cut.select("user_id", F.struct("start", F.col("end") - F.col("start")).alias("place"), (F.col("end") - F.col("start")).alias("duration"))
    return tl.budgeted(cut, "user_id", "place", "duration", 600.0).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"))


_RANGES = f"""WITH {SPANS}, g AS (SELECT user_id, coalesce(max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, least("start", total) AS b FROM spans UNION ALL SELECT user_id, max("end"), max(total) FROM spans GROUP BY user_id),
y AS (SELECT user_id, a, b FROM g WHERE b - a >= 0.40), z AS (SELECT user_id, a + 7200 * k AS s, least(a + 7200 * (k + 1), b) AS e FROM (SELECT user_id, a, b, unnest(range(greatest(CAST(ceil((b - a) / 7200) AS BIGINT), 1))) AS k FROM y)),
l AS (SELECT user_id, s, e, row_number() OVER (PARTITION BY user_id ORDER BY s) AS place FROM z WHERE e - s >= 0.25), t AS (SELECT conv_id % 15 AS user_id, text, row_number() OVER (PARTITION BY conv_id % 15 ORDER BY conv_id, turn) AS place FROM conversations)
SELECT l.user_id, l.place, l.s AS start, l.e AS "end", coalesce(t.text, '...') AS text FROM l LEFT JOIN t ON t.user_id = l.user_id AND t.place = l.place"""


@query("u07_timeline_cues", _RANGES)
def timeline_cues(spark, sf_dir):
    """Complement of the silences, split, and the reference lines set on it in turn."""
    ranges = tl.split_long(tl.complement(spans(spark, sf_dir), "user_id", "total", 0.0, 0.40), 7200.0)
    text = table(spark, sf_dir, "conversations").selectExpr("conv_id % 15 AS user_id", "struct(conv_id, turn) AS nth", "text")
    joined = tl.zip_rows(ranges.select("user_id", "start", "end"), text, "user_id", "start", "nth").where("start IS NOT NULL")
    return joined.select("user_id", F.col("place").cast("long").alias("place"), "start", "end", F.coalesce("text", F.lit("...")).alias("text"))


@query("u08_strategy_cascade", "WITH c AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS strategy FROM events WHERE value > 20), n AS (SELECT user_id, strategy FROM c GROUP BY 1, 2 HAVING count(*) >= CASE strategy WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END), m AS (SELECT user_id, min(strategy) AS strategy FROM n GROUP BY user_id) SELECT user_id, strategy, event_id FROM c JOIN m USING (user_id, strategy)")
def strategy_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "events").where("value > 20").selectExpr("user_id", "event_id", "CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS strategy")
    return op.cascade(c, "user_id", "strategy", {1: 3, 2: 2})


# --- scalars


_AUDIO = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) & 4294967295) AS w FROM embeddings), c AS (SELECT vec_id, w, list_transform(v, lambda t: t - list_sum(v) / len(v)) AS c FROM e), n AS (SELECT vec_id, w, c, sqrt(list_sum(list_transform(c, lambda t: t * t))) AS norm FROM c)"


@query("x13_audio_dispatch", f"{_AUDIO} SELECT l.vec_id, CASE WHEN l.vec_id % 7 = 0 OR r.vec_id % 7 = 0 THEN -1.0::DOUBLE WHEN l.vec_id % 4 > 1 AND r.vec_id % 4 > 1 THEN {_bits('l.w', 'r.w')} WHEN l.vec_id % 5 > 0 AND r.vec_id % 5 > 0 THEN {_COSINE} ELSE -1.0::DOUBLE END AS similarity FROM n l JOIN n r ON r.vec_id = l.vec_id + 1")
def audio_dispatch(spark, sf_dir):
    """Similarity of neighbouring vectors as audio items, of which some failed and some lack a fingerprint or an envelope."""
    v, none = F.col("embedding").cast("array<double>"), F.lit(None)
    item = F.struct(F.when(F.expr("vec_id % 4 > 1"), _words(F.col("embedding"))).alias("fingerprint"), F.when(F.expr("vec_id % 5 > 0"), v).otherwise(none).alias("envelope"), F.when(F.expr("vec_id % 7 = 0"), "unreadable").alias("error"))
    items = table(spark, sf_dir, "embeddings").select("vec_id", item.alias("a"))
    near = items.join(items.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return near.select("vec_id", similar.audio_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("x23_decisions", "SELECT p_partkey, CASE WHEN p_partkey % 50 = 7 THEN 'adopt' WHEN contains(lower(p_name), 'widget') AND p_retailprice < 1000 THEN 'study' WHEN p_type = 'PROMO' THEN 'avoid' ELSE 'watch' END AS decision FROM part")
def decisions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    fixed = p.where("p_partkey % 50 = 7").select("p_partkey", F.lit("adopt").alias("fixed"))
    rules = F.when(F.contains(F.lower("p_name"), F.lit("widget")) & (F.col("p_retailprice") < 1000), "study").when(F.col("p_type") == "PROMO", "avoid").otherwise("watch")
    return p.join(fixed, "p_partkey", "left").select("p_partkey", F.coalesce("fixed", rules).alias("decision"))


@query("x28_render_specs", "SELECT conv_id, turn, printf('%d:%s:%05d', turn, role, length(text)) AS spec FROM conversations")
def render_specs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("%d:%s:%05d", "turn", "role", F.length("text")).alias("spec"))


@query("x29_forbidden_terms", '''WITH t AS (SELECT doc_id, x.term, instr(lower(text), x.term) AS "at" FROM documents, (VALUES ('token'), ('password'), ('licen'), ('@')) x(term)) SELECT doc_id, "at", term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "at", term) AS k FROM t WHERE "at" > 0) WHERE k = 1''')
def forbidden_terms(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", op.first_term(F.col("text"), ["token", "password", "licen", "@"]).alias("hit")).where("hit IS NOT NULL")
    return d.select("doc_id", F.col("hit.at").cast("long").alias("at"), F.col("hit.term").alias("term"))


@query("x30_reference_clauses", "WITH c AS (SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) THEN string_split(text, chr(10)) ELSE regexp_extract_all(text, '[^.!?,]+[.!?,]?') END AS p FROM conversations) SELECT conv_id, turn, list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> '') AS clauses FROM c")
def reference_clauses(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", op.split_reference(F.col("text")).alias("clauses"))


@query("x34_repeated_segments", f'WITH {SPANS}, w AS (SELECT user_id, "start", "end", lag("start") OVER v AS s, lag("end") OVER v AS e FROM spans WINDOW v AS (PARTITION BY user_id ORDER BY "start", "end")) SELECT user_id, "start", "end", coalesce(least("end", e) - greatest("start", s) >= 60 OR "start" - s < 900, false) AS repeats FROM w')
def repeated_segments(spark, sf_dir):
    return op.near_previous(spans(spark, sf_dir).select("user_id", "start", "end"), "user_id", 60.0, 900.0)


@query("x35_dedup_levels", "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'strong' WHEN 'ECONOMY' THEN 'light' ELSE 'standard' END AS level FROM part")
def dedup_levels(spark, sf_dir):
    names = F.create_map(F.lit("PROMO"), F.lit("strong"), F.lit("ECONOMY"), F.lit("light"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(names, F.col("p_type")), F.lit("standard")).alias("level"))


# --- upkeep


_FINAL = """, d AS (SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'completed' ELSE 'failed' END AS o, '/done/' || task_id AS p FROM ledger WHERE task_id % 3 = 0 AND status IN ('tts_done', 'pending'))
SELECT l.task_id, coalesce(a.o, CASE WHEN l.status = 'waiting_dependency' THEN b.o END, l.status) AS status, coalesce(a.p, CASE WHEN l.status = 'waiting_dependency' THEN b.p END, l.output_path) AS output_path FROM ledger l LEFT JOIN d a ON a.task_id = l.task_id LEFT JOIN d b ON b.task_id = l.leader_task_id"""


@query("m04_finalize_leaders", LEDGER + _FINAL)
def finalize_leaders(spark, sf_dir):
    led = ledger(spark, sf_dir)
    done = led.where("task_id % 3 = 0").select("task_id", F.expr("CASE WHEN task_id % 2 = 0 THEN 'completed' ELSE 'failed' END").alias("outcome"), F.expr("concat('/done/', task_id)").alias("output"))
    return op.finalize(led, done, ("tts_done", "pending"))


@query("m11_active_films", '''WITH u AS (SELECT c_custkey AS film, 1000.0::DOUBLE AS "at", 'old' AS title FROM customer UNION ALL SELECT event_id % 400, CAST(event_id AS DOUBLE) * 10, event_type FROM events), n AS (SELECT film, max("at") AS "at", arg_max(title, "at") AS title FROM u GROUP BY film) SELECT film, "at", title FROM n WHERE 8000 - "at" <= 6500''')
def active_films(spark, sf_dir):
    old = table(spark, sf_dir, "customer").selectExpr("c_custkey AS film", "1000.0D AS at", "'old' AS title")
    new = table(spark, sf_dir, "events").selectExpr("event_id % 400 AS film", "CAST(event_id AS DOUBLE) * 10 AS at", "event_type AS title")
    return op.upsert_active(old, new, "film", "at", F.lit(8000.0), 6500.0)


@query("m13_to_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus = 'F')")
def to_resume(spark, sf_dir):
    ends = orders(spark, sf_dir, "o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'failed' END AS status").where("o_orderkey % 5 = 0")
    return op.to_resume(orders(spark, sf_dir, "o_orderkey"), ends, "o_orderkey", retry_failed=True)


@query("m15_unfinished_sessions", "SELECT user_id, max(event_id // 20) AS session FROM events WHERE event_type = 'signup' GROUP BY user_id")
def unfinished_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id div 20 AS session", "event_id div 20 AS created", "event_type")
    return op.unfinished_session(e, "session", "created", F.col("event_type") == "signup", "user_id")


@query("m16_retained_jobs", "WITH j AS (SELECT o_orderkey, o_custkey, o_orderstatus <> 'O' AS f, epoch_us(o_orderdate) / 1000000.0::DOUBLE AS a, max(epoch_us(o_orderdate)) OVER () / 1000000.0::DOUBLE AS now FROM orders), y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, f ORDER BY a DESC, o_orderkey DESC) AS k FROM j WHERE NOT f OR now - a <= 1000 * 86400) SELECT o_orderkey FROM y WHERE NOT f OR k <= 2")
def retained_jobs(spark, sf_dir):
    at = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', o_orderdate) / 1000000.0D"
    j = orders(spark, sf_dir, "o_orderkey", "o_custkey", f"struct({at} AS at, o_orderkey) AS at", "o_orderstatus")
    now = j.agg(F.max("at.at")).scalar()
    return op.retained(j, "o_custkey", "at", F.col("o_orderstatus") != "O", now - F.col("at.at"), 1000.0 * 86400, 2).select("o_orderkey")


@query("w01_inserted_tasks", "SELECT o_orderkey, left(sha1((o_custkey % 10) || '|' || o_orderkey), 16) AS task_id, CASE WHEN o_orderkey % 4 = 1 AND EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey - 10 AND p.o_custkey % 10 = o.o_custkey % 10) THEN left(sha1((o_custkey % 10) || '|' || (o_orderkey - 10)), 16) END AS leader_task_id FROM orders o")
def inserted_tasks(spark, sf_dir):
    o = orders(spark, sf_dir, "o_custkey % 10 AS batch", "o_orderkey", "CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey - 10 END AS leader_row")
    return op.with_ids(o, "batch", "o_orderkey", "leader_row").select("o_orderkey", "task_id", "leader_task_id")


@query("w02_updated_columns", "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def updated_columns(spark, sf_dir):
    o = orders(spark, sf_dir, "o_orderkey", "o_orderstatus", "o_orderpriority")
    return op.update_columns(o, o.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus")), "o_orderkey", ("o_orderstatus",))


@query("w03_reservations", "WITH e AS (SELECT event_id % 2000 AS k, arg_max(CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'release' ELSE 'touch' END, event_id) AS a FROM events GROUP BY 1) SELECT o_orderkey AS k, CASE WHEN a = 'commit' THEN '/out/' || o_orderkey END AS output_path, CASE WHEN a IN ('commit', 'release') THEN NULL ELSE '/out/' || o_orderkey END AS reserved_path FROM orders LEFT JOIN e ON e.k = o_orderkey")
def reservations(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id % 2000 AS k", "event_id AS seq", "CASE event_type WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'release' ELSE 'touch' END AS action")
    return op.settle_reservations(orders(spark, sf_dir, "o_orderkey AS k", "concat('/out/', o_orderkey) AS reserved_path"), e, "k", "seq")


@query("w04_bulk_reset", LEDGER + "SELECT task_id, CASE WHEN batch_id = 3 AND status IN ('failed', 'cancelled') THEN 'pending' ELSE status END AS status FROM ledger")
def bulk_reset(spark, sf_dir):
    return op.bulk_reset(ledger(spark, sf_dir), F.col("batch_id") == 3, ("failed", "cancelled"), "pending").select("task_id", "status")


@query("w06_imported_feedback", RECORDS + ", m AS (SELECT 'clip_' || (o_orderkey % 350) || '.mp4' AS name, min('/out/Clip_' || (o_orderkey % 350) || '.mp4') AS path FROM orders GROUP BY 1) SELECT seq, CASE WHEN status = 'pending' THEN 'invalid' WHEN path IS NULL THEN 'unmatched' ELSE 'appended' END AS outcome, path AS matched_path FROM records LEFT JOIN m ON m.name = file")
def imported_feedback(spark, sf_dir):
    m = orders(spark, sf_dir, "concat('/out/Clip_', o_orderkey % 350, '.mp4') AS path")
    errors = F.array_compact(F.array(F.when(F.col("status") == "pending", "status is not final")))
    return op.import_feedback(records(spark, sf_dir), errors, m, "file").select("seq", "outcome", "matched_path")


@query("w07_release_log", LEDGER + "SELECT 'released' AS action, task_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY task_id) AS nth FROM ledger WHERE status = 'completed'")
def release_log(spark, sf_dir):
    done = ledger(spark, sf_dir).where(F.col("status") == lg.TERMINAL[0])
    return done.selectExpr("'released' AS action", "task_id", "batch_id", "CAST(row_number() OVER (PARTITION BY batch_id ORDER BY task_id) AS BIGINT) AS nth")
