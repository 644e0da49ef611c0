"""Feeds, folds, subtitles and writes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normal, text, times
from ..operators import folds, similarity
from ..operators import timeline as tl
from ..sources import sinks, tables
from ..streaming import feeds
from .registry import query, table
from .timeline_queries import AT, AT_SQL, SPANS, spans

KINDS = "CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'fail' WHEN 'purchase' THEN 'ok' ELSE 'ask' END"


@query("m01_latest_state", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def latest_state(spark, sf_dir):
    return feeds.latest_state(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("f06_prune_expired", f"SELECT event_id AS id FROM events WHERE ({AT_SQL}) / 1000000.0::DOUBLE >= 2600000 - 43200")
def prune_expired(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.expr(f"{AT} / 1000000.0D").alias("last_active"))
    return feeds.expire(e, 2_600_000.0).select("id")


@query("m08_recent_failures", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {AT_SQL} RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error'")
def recent_failures(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.expr(AT).alias("at"))
    return tl.trailing_count(e, "user_id", "at", 86400).select("event_id", "recent")


@query("m06_breaker_replay")
def breaker_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.expr(f"{AT} / 1000000.0D").alias("at"), F.expr(KINDS).alias("kind"), F.lit(None).cast("double").alias("retry_after"))
    return folds.replay_breaker(e, "user_id", failures=3, open_seconds=7200.0, lease=3600.0)


@query("m07_scaler_replay")
def scaler_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "user_id", F.expr(f"{AT} / 1000000.0D").alias("at"), F.expr("event_id % 5").alias("backlog"), F.expr("CAST(event_id % 40 AS DOUBLE)").alias("free_gb"), F.col("value").alias("throughput"),
        (F.col("event_type") == "signup").alias("breaker_open"), F.expr("event_id % 11 = 0").alias("saturated"), (F.col("event_type") == "error").alias("hw_failure"),
    )
    return folds.replay_scaler(e, "user_id", 6, 8)


def _rounds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("machine"), F.col("l_linenumber").alias("concurrency"), F.floor("l_extendedprice").alias("rate"), (F.col("l_discount") < 0.095).alias("ok"))


@query("a14_ladder_steps", "SELECT l_suppkey AS machine, l_linenumber AS concurrency, CAST(quantile_disc(floor(l_extendedprice), 0.5) AS DOUBLE) AS rate, bool_and(l_discount < 0.095::DOUBLE) AS stable FROM lineitem GROUP BY 1, 2")
def ladder_steps(spark, sf_dir):
    return folds.ladder_steps(_rounds(spark, sf_dir), "machine").withColumn("rate", F.col("rate").cast("double"))


@query("a14_recommended", "WITH s AS (SELECT l_suppkey AS machine, l_linenumber AS concurrency, CAST(quantile_disc(floor(l_extendedprice), 0.5) AS DOUBLE) AS rate, bool_and(l_discount < 0.095::DOUBLE) AS stable FROM lineitem GROUP BY 1, 2), w AS (SELECT *, lag(rate) OVER (PARTITION BY machine ORDER BY concurrency) AS below FROM s WHERE stable), b AS (SELECT machine, max(concurrency) AS concurrency FROM w WHERE below IS NULL OR below <= 0 OR (rate - below) / below >= 0.05::DOUBLE GROUP BY machine) SELECT m.machine, coalesce(b.concurrency, 1) AS concurrency FROM (SELECT DISTINCT machine FROM s) m LEFT JOIN b USING (machine)")
def recommended(spark, sf_dir):
    return folds.recommend(folds.ladder_steps(_rounds(spark, sf_dir), "machine"), "machine")


@query("a15_error_classes", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE contains(props, '7')) AS session_errors FROM events GROUP BY user_id")
def error_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    return e.groupBy("user_id").agg(F.count_if(bad).alias("failures"), F.count_if(~bad).alias("successes"), F.count_if(F.contains("props", F.lit("7"))).alias("session_errors"))


def _cue_files(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.5).alias("end"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return sinks.subtitle_text(c, "conv_id")


@query("k03_subtitle_text", "SELECT conv_id, string_agg(k || chr(10) || printf('%02d:%02d:%02d,000', turn // 3600, turn // 60 % 60, turn % 60) || ' --> ' || printf('%02d:%02d:%02d,500', turn // 3600, turn // 60 % 60, turn % 60) || chr(10) || t || chr(10), chr(10) ORDER BY k) AS content FROM (SELECT conv_id, turn, trim(t) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS t FROM conversations) WHERE trim(t) <> '') GROUP BY conv_id")
def subtitle_text(spark, sf_dir):
    return _cue_files(spark, sf_dir)


@query("s09_parsed_cues", "SELECT conv_id, CAST(turn AS DOUBLE) AS start, turn + 0.5::DOUBLE AS \"end\", trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def parsed_cues(spark, sf_dir):
    return _cue_files(spark, sf_dir).select("conv_id", F.explode(tables.cues_of(F.col("content"))).alias("c")).select("conv_id", "c.start", "c.end", "c.text")


@query("s23_log_silences", "SELECT event_id, CAST(event_id AS DOUBLE) AS start, event_id + 1.5::DOUBLE AS \"end\" FROM events")
def log_silences(spark, sf_dir):
    log = F.concat(F.lit("[silencedetect] silence_start: "), F.col("event_id"), F.lit("\n[silencedetect] silence_end: "), F.col("event_id") + 1.5, F.lit(" | silence_duration: 1.5"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(tables.log_silences(log)).alias("s")).select("event_id", "s.start", "s.end")


@query("s10_aliased_columns", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS source FROM customer")
def aliased_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_name END").alias("file"), F.col("c_mktsegment").alias("video"))
    return tables.aliased(c, {"c_custkey": ["c_custkey"], "source": ["source", "file", "video"]}).select(F.col("c_custkey").cast("long").alias("c_custkey"), "source")


@query("k08_plan_rows", "SELECT 'segment' AS row_type, o_orderstatus AS strategy, o_orderkey AS id, CAST(NULL AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'unmatched_audio', NULL, o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'unmatched_video', NULL, o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT 'summary', o_orderstatus, NULL, count(*) FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_orderstatus")
def plan_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("strategy"), F.lit(1).alias("duration"))
    rest = o.select("id")
    return sinks.plan_rows(o.where("id % 3 = 0"), rest.where("id % 3 = 1"), rest.where("id % 3 = 2")).select("row_type", "strategy", "id", "n")


@query("k11_archive_document", "SELECT '{\"parts\":{\"customer\":' || (SELECT count(*) FROM customer) || ',\"none\":0,\"orders\":' || (SELECT count(*) FROM orders) || '},\"missing\":[\"none\"]}' AS document")
def archive_document(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return sinks.archive_document({"customer": c, "orders": table(spark, sf_dir, "orders"), "none": c.where("c_custkey < 0")}, c)


@query("k05_extra_columns", "SELECT c_custkey, map_from_entries([('c_acctbal', CAST(c_acctbal AS VARCHAR)), ('c_mktsegment', c_mktsegment)])['c_mktsegment'] AS segment FROM customer")
def extra_columns(spark, sf_dir):
    c = sinks.with_extras(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ["c_custkey"])
    return c.select("c_custkey", F.try_element_at("extras", F.lit("c_mktsegment")).alias("segment"))


@query("u05_kept_regions", f"WITH {SPANS}, g AS (SELECT user_id, coalesce(max(\"end\") OVER (PARTITION BY user_id ORDER BY \"start\", \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, least(\"start\", total) AS b FROM spans UNION ALL SELECT user_id, max(\"end\"), max(total) FROM spans GROUP BY user_id) SELECT user_id, 'gap' AS kind, a AS \"start\", b AS \"end\" FROM g WHERE b - a >= 1 UNION ALL SELECT user_id, 'head', \"start\", least(\"end\", \"start\" + 30) FROM spans")
def kept_regions(spark, sf_dir):
    """Gaps between silences, and the head of each silence up to 30 seconds."""
    s = spans(spark, sf_dir)
    gaps = tl.complement(s, "user_id", "total", 0.0, 1.0).select("user_id", F.lit("gap").alias("kind"), "start", "end")
    return gaps.unionByName(s.select("user_id", F.lit("head").alias("kind"), "start", F.least("end", F.col("start") + 30).alias("end")))


_PHRASES = """WITH u AS (SELECT item_id, trim(regexp_replace(regexp_replace(p, '\\p{P}+', '', 'g'), '\\s+', ' ', 'g')) AS phrase, i FROM (SELECT item_id, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[,.!?;:\\n]+') AS parts FROM benchmark))),
d AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS place, length(phrase) AS chars, count(*) OVER (PARTITION BY item_id) AS n, 9.0::DOUBLE * length(phrase) / sum(length(phrase)) OVER (PARTITION BY item_id) AS raw FROM u WHERE phrase <> ''),
f AS (SELECT *, CASE WHEN n * 0.4::DOUBLE <= 9.0::DOUBLE + 1e-9 THEN greatest(0.4::DOUBLE, raw) ELSE raw END AS lifted FROM d),
o AS (SELECT *, sum(lifted) OVER (PARTITION BY item_id) - 9.0 AS above, sum(lifted - 0.4::DOUBLE) OVER (PARTITION BY item_id) AS slack FROM f),
t AS (SELECT *, lifted - CASE WHEN n * 0.4::DOUBLE <= 9.0::DOUBLE + 1e-9 AND above > 1e-9 AND slack > 1e-9 THEN above * (lifted - 0.4::DOUBLE) / slack ELSE 0.0 END AS d FROM o),
e AS (SELECT item_id, place, CASE WHEN place = n - 1 THEN 9.0::DOUBLE ELSE least(9.0::DOUBLE, sum(d) OVER (PARTITION BY item_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS stop FROM t)
SELECT item_id, CAST(place AS INTEGER) AS place, round_even(coalesce(lag(stop) OVER (PARTITION BY item_id ORDER BY place), 0.0), 3) AS start, round_even(stop, 3) AS "end" FROM e"""


@query("t15_phrase_times", _PHRASES)
def phrase_times(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(text.phrases(F.col("text"))).alias("place", "phrase"))
    return tl.phrase_times(b.select("item_id", "place", F.length("phrase").alias("chars"), F.lit(0.0).alias("start"), F.lit(9.0).alias("end")), "item_id", "place")


@query("x24_backoff", "SELECT event_id, greatest(0.1::DOUBLE, least(30.0::DOUBLE, pow(2.0, event_id % 9))) AS delay FROM events")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.backoff(F.expr("event_id % 9 + 1")).alias("delay"))


@query("x31_retry_after", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) WHEN event_id % 3 = 1 THEN 3600.0::DOUBLE ELSE NULL END AS wait FROM events")
def retry_after(spark, sf_dir):
    t = F.expr("CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS STRING) WHEN event_id % 3 = 1 THEN 'Mon, 01 Jan 2024 01:00:00 GMT' ELSE 'later' END")
    start = F.unix_timestamp(F.to_timestamp(F.lit("2024-01-01 00:00:00"))).cast("double")
    return table(spark, sf_dir, "events").select("event_id", times.retry_after(t, start).alias("wait"))


@query("x20_variation_fields", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'dedup_color,dedup_crop' ELSE 'dedup_crop' END AS fields FROM events")
def variation_fields(spark, sf_dir):
    m = F.create_map(F.lit("dedup_color"), F.expr("CAST(event_id % 2 = 0 AS STRING)"), F.lit("dedup_crop"), F.lit("true"), F.lit("title"), F.lit("true"))
    on = F.map_filter(m, lambda k, v: k.startswith("dedup_") & (v == "true"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(on)), ",").alias("fields"))


@query("x33_captions", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || c_mktsegment ELSE '' END AS caption FROM customer")
def captions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("d", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END"))
    return c.select("c_custkey", F.concat_ws("\n", "c_name", F.nullif("d", "c_name")).alias("caption"))


@query("x32_rework_conclusion", "SELECT l_suppkey AS batch, CASE WHEN count(*) = 0 THEN 'no_pairs' WHEN count(*) FILTER (WHERE l_quantity >= 46) > 0 THEN 'still_high' WHEN count(*) FILTER (WHERE l_returnflag = 'N') > 0 THEN 'incomplete' ELSE 'resolved' END AS conclusion FROM lineitem GROUP BY l_suppkey")
def rework_conclusion(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 46).alias("high"), F.count_if(F.col("l_returnflag") == "N").alias("open"))
    return g.select("batch", F.when(F.col("n") == 0, "no_pairs").when(F.col("high") > 0, "still_high").when(F.col("open") > 0, "incomplete").otherwise("resolved").alias("conclusion"))


_REWORK = """WITH o AS (SELECT p_partkey AS output, p_partkey % 40 AS source FROM part WHERE p_partkey % 2 = 0), w AS (SELECT p_partkey + 500000 AS output, p_partkey % 40 AS source FROM part WHERE p_partkey % 4 = 0),
op AS (SELECT output, source, row_number() OVER (PARTITION BY source ORDER BY output) AS place FROM o), wp AS (SELECT output, source, row_number() OVER (PARTITION BY source ORDER BY output) AS place FROM w),
m AS (SELECT op.output AS old, wp.output AS new FROM op LEFT JOIN wp USING (source, place)), h AS (SELECT l_partkey AS left_id, 2 * l_suppkey AS right_id, l_quantity / 50 AS was FROM lineitem WHERE l_quantity >= 49 AND l_partkey <> 2 * l_suppkey),
n AS (SELECT least(500000 + l_partkey, 500000 + 4 * l_suppkey) AS lo, greatest(500000 + l_partkey, 500000 + 4 * l_suppkey) AS hi, max(l_discount * 10) AS now FROM lineitem GROUP BY 1, 2)
SELECT h.left_id, h.right_id, h.was, n.now, CASE WHEN a.new IS NULL OR b.new IS NULL THEN 'no_new_output' WHEN n.now IS NULL THEN 'no_new_pair' WHEN n.now >= 0.5 THEN 'still_high' ELSE 'resolved' END AS reason
FROM h LEFT JOIN m a ON a.old = h.left_id LEFT JOIN m b ON b.old = h.right_id LEFT JOIN n ON n.lo = least(a.new, b.new) AND n.hi = greatest(a.new, b.new)"""


@query("j08_compare_rework", _REWORK)
def compare_rework(spark, sf_dir):
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    old = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("output"), F.expr("p_partkey % 40").alias("source"))
    new = p.where("p_partkey % 4 = 0").select((F.col("p_partkey") + 500000).alias("output"), F.expr("p_partkey % 40").alias("source"))
    high = l.where("l_quantity >= 49 AND l_partkey <> 2 * l_suppkey").select(F.col("l_partkey").alias("left_id"), F.expr("2 * l_suppkey").alias("right_id"), (F.col("l_quantity") / 50).alias("similarity"), F.lit("high").alias("level"))
    fresh = l.select((F.col("l_partkey") + 500000).alias("left_id"), F.expr("500000 + 4 * l_suppkey").alias("right_id"), (F.col("l_discount") * 10).alias("similarity"))
    return similarity.compare_rework(high, old, new, fresh, 0.5)


@query("j12_resolved_files", "SELECT id, coalesce(max(p) FILTER (WHERE root = 0), max(p) FILTER (WHERE root = 1)) AS found FROM (SELECT e.event_id AS id, s.root, s.p FROM events e LEFT JOIN (SELECT s_suppkey % 2 AS root, 'clip' || s_suppkey || '.mp4' AS name, '/r' || (s_suppkey % 2) || '/clip' || s_suppkey || '.mp4' AS p FROM supplier) s ON s.name = 'clip' || (e.event_id % 150) || '.mp4') GROUP BY id")
def resolved_files(spark, sf_dir):
    """A record's file by its base name, the first root that has it."""
    s = table(spark, sf_dir, "supplier").select(F.expr("s_suppkey % 2").alias("root"), F.expr("concat('/r', s_suppkey % 2, '/clip', s_suppkey, '.mp4')").alias("p"))
    first = s.groupBy(normal.basename(F.col("p")).alias("name")).agg(F.min_by("p", F.struct("root", "p")).alias("found"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), normal.basename(F.expr("concat('/old/Clip', event_id % 150, '.mp4')")).alias("name"))
    return e.join(first, "name", "left").select("id", "found")
