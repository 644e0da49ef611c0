"""Rules of records, reports and renders, applied by the library's functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import render, text
from ..operators import fusion, records, similarity
from .registry import query, table
from .timeline_queries import AT, AT_SQL


@query("t16_pending_in_order", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def pending_in_order(spark, sf_dir):
    done = table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("event_id AS o_orderkey")
    return records.pending(table(spark, sf_dir, "orders"), done, "o_orderkey", "o_custkey", "o_orderdate")


#: Classes of failures, by terms of their messages.
CLASSES = {"sessions": ('"k": 1', '"k": 2'), "memory": ('"k": 3',), "decode": ('"k": 4', '"k": 5')}


@query("a15_step_summary", f"""SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS successes, count(*) FILTER (WHERE event_type = 'error') AS failures,
  count(*) FILTER (WHERE event_type = 'error' AND k = 'sessions') AS sessions, count(*) FILTER (WHERE event_type = 'error' AND k = 'memory') AS memory, count(*) FILTER (WHERE event_type = 'error' AND k = 'decode') AS decode, count(*) FILTER (WHERE event_type = 'error' AND k = 'other') AS other,
  CASE WHEN max("at") > min("at") THEN round(count(*) FILTER (WHERE event_type <> 'error') * 3600 / CAST(max("at") - min("at") AS DOUBLE), 2) END AS per_hour
FROM (SELECT *, ({AT_SQL}) // 1000000 AS "at", CASE WHEN contains(props, '"k": 1') OR contains(props, '"k": 2') THEN 'sessions' WHEN contains(props, '"k": 3') THEN 'memory' WHEN contains(props, '"k": 4') OR contains(props, '"k": 5') THEN 'decode' ELSE 'other' END AS k FROM events) GROUP BY user_id""")
def step_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return records.step_summary(e, ["user_id"], F.col("event_type") != "error", F.expr(f"{AT} div 1000000"), F.col("props"), CLASSES)


@query("x28_render_filters", """WITH c AS (SELECT conv_id, turn, length(text) / 4 AS d, role, coalesce(sum(length(text) / 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM conversations)
SELECT conv_id, turn, CASE WHEN turn > 1 THEN printf('xfade=transition=%s:duration=%.2f:offset=%.2f', CASE role WHEN 'user' THEN 'fadeblack' ELSE 'dissolve' END, CASE role WHEN 'user' THEN 0.5 ELSE 0.25 END::DOUBLE, greatest(0, cut - CASE role WHEN 'user' THEN 0.5 ELSE 0.25 END::DOUBLE)) END AS transition,
  printf('adelay=%d|%d', CAST(floor(cut * 1000) AS BIGINT), CAST(floor(cut * 1000) AS BIGINT)) AS delay FROM c""")
def render_filters(spark, sf_dir):
    """Turns as clips of a quarter second for each character."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (F.length("text") / 4).alias("d"))
    cut = F.coalesce(F.sum("d").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    c = c.withColumn("cut", cut).withColumn("t", F.when(F.col("role") == "user", 0.5).otherwise(0.25))
    kind = F.when(F.col("turn") > 1, F.when(F.col("role") == "user", "fadeblack").otherwise("dissolve"))
    return c.select("conv_id", "turn", render.transition_filter(kind, F.col("t"), render.transition_offset(F.col("cut"), F.col("t"))).alias("transition"), render.delay_filter(F.col("cut")).alias("delay"))


@query("x32_reworked_batches", """SELECT l_suppkey AS batch, CASE WHEN count(*) FILTER (WHERE l_quantity < 45) = count(*) THEN 'unknown' ELSE
  CASE WHEN count(*) FILTER (WHERE l_quantity >= 50) > 0 THEN 'still_high: ' || count(*) FILTER (WHERE l_quantity >= 50) ELSE 'lower' END || CASE WHEN count(*) FILTER (WHERE l_quantity < 45) > 0 THEN '; ' || count(*) FILTER (WHERE l_quantity < 45) || ' not aligned' ELSE '' END END AS conclusion
FROM lineitem WHERE l_quantity >= 35 GROUP BY l_suppkey""")
def reworked_batches(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").where("l_quantity >= 35").groupBy(F.col("l_suppkey").alias("batch")).agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") >= 50).alias("high"), F.count_if(F.col("l_quantity") < 45).alias("open"))
    return g.select("batch", similarity.rework_conclusion(F.col("high"), F.col("open"), F.col("n")).alias("conclusion"))


@query("x34_apart_from_all", f"""WITH RECURSIVE c AS (SELECT user_id, event_id, (({AT_SQL}) // 1000000) % 7200 * 0.25::DOUBLE AS s, (event_id % 60 + 1) * 0.25::DOUBLE AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, s DOUBLE, d DOUBLE)[]) AS taken FROM (SELECT DISTINCT user_id FROM c)
UNION ALL SELECT r.user_id, c.k, CASE WHEN len(list_filter(r.taken, lambda x: least(c.s + c.d, x.s + x.d) - greatest(c.s, x.s) >= 0.25 OR abs(c.s - x.s) < 6)) = 0 THEN list_append(taken, CAST({{'id': c.event_id, 's': c.s, 'd': c.d}} AS STRUCT(id BIGINT, s DOUBLE, d DOUBLE))) ELSE taken END FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1)
SELECT user_id, unnest(max_by(taken, k)).id AS event_id FROM r GROUP BY user_id""")
def apart_from_all(spark, sf_dir):
    """Segments in turn, without those near any that was taken before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(f"({AT} div 1000000) % 7200 * 0.25D").alias("start"), F.expr("(event_id % 60 + 1) * 0.25D").alias("duration"))
    return fusion.without_near(e, ["user_id"], [F.col("event_id")], 6.0).select("user_id", "event_id")


_ROOTS = "f AS (SELECT s_suppkey, s_suppkey % 3 AS root, s_suppkey % 2 + 1 AS depth, '/r' || (s_suppkey % 3) || CASE WHEN s_suppkey % 2 = 1 THEN '/d' || (s_suppkey % 5) ELSE '' END || '/clip' || (s_suppkey % 30) || '.mp4' AS p, 'clip' || (s_suppkey % 30) || '.mp4' AS name FROM supplier)"


@query("j12_in_roots", f"""WITH {_ROOTS}, w AS (SELECT DISTINCT CASE WHEN event_id % 4 = 0 THEN '/r1/d' || (event_id % 5) || '/clip' || (event_id % 40) || '.mp4' ELSE 'clip' || (event_id % 40) || '.mp4' END AS value, 'clip' || (event_id % 40) || '.mp4' AS name FROM events),
m AS (SELECT value, p, row_number() OVER (PARTITION BY value ORDER BY CASE WHEN p = value THEN 0 WHEN depth = 1 THEN 1 ELSE 2 END, CASE WHEN p = value THEN 0 ELSE root END, p) AS k FROM w JOIN f USING (name))
SELECT w.value, m.p AS path FROM w LEFT JOIN m ON m.value = w.value AND m.k = 1""")
def in_roots(spark, sf_dir):
    listing = table(spark, sf_dir, "supplier").selectExpr("concat('/r', s_suppkey % 3, CASE WHEN s_suppkey % 2 = 1 THEN concat('/d', s_suppkey % 5) ELSE '' END, '/clip', s_suppkey % 30, '.mp4') AS path", "s_suppkey % 3 AS root", "s_suppkey % 2 + 1 AS depth")
    wanted = table(spark, sf_dir, "events").selectExpr("CASE WHEN event_id % 4 = 0 THEN concat('/r1/d', event_id % 5, '/clip', event_id % 40, '.mp4') ELSE concat('clip', event_id % 40, '.mp4') END AS value").distinct()
    return records.resolve_paths(wanted, listing, "value", by_root=True)


_NAT = "lpad(CAST(length(CAST(c_custkey % 90 AS VARCHAR)) AS VARCHAR), 6, '0') || (c_custkey % 90)"


@query("s18_entries_in_order", f"""WITH m AS (SELECT c_nationkey AS folder, c_custkey % 90 AS n, 'take' || (c_custkey % 90) || '.wav' AS file, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row, c_custkey, {_NAT} AS nat FROM customer),
r AS (SELECT folder, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 50 ELSE row END AS index, file, CASE WHEN c_custkey % 2 = 0 THEN c_custkey / 8 END AS seconds, nat, c_custkey FROM m WHERE folder % 4 <> 1 AND c_custkey % 7 <> 0),
p AS (SELECT DISTINCT folder, file, nat FROM m WHERE folder NOT IN (SELECT folder FROM r))
SELECT folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY index, nat, file, seconds NULLS FIRST) AS INTEGER) AS place, index, file, seconds FROM r
UNION ALL SELECT folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY nat) AS INTEGER), row_number() OVER (PARTITION BY folder ORDER BY nat), file, NULL FROM p""")
def entries_in_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    file = F.expr("concat('take', c_custkey % 90, '.wav')")
    row = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    rows = c.withColumn("row", row).where("c_nationkey % 4 <> 1")
    manifest = rows.select(F.col("c_nationkey").alias("folder"), "row", F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat(' ', c_custkey % 50) ELSE 'x' END").alias("index"), F.when(F.expr("c_custkey % 7 <> 0"), F.concat(F.lit('"'), file, F.lit('"'))).alias("file"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey / 8 AS STRING) END").alias("seconds"))
    return records.audio_entries(manifest, c.select(F.col("c_nationkey").alias("folder"), file.alias("file")).distinct())


@query("r07_long_numbers", "SELECT p_partkey, 'take' || lpad(CAST(length(n) + 24 AS VARCHAR), 6, '0') || n || '123456789012345678901234' AS sort_key FROM (SELECT p_partkey, CASE WHEN p_partkey > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS n FROM part)")
def long_numbers(spark, sf_dir):
    """Runs of more digits than any number type holds."""
    return table(spark, sf_dir, "part").select("p_partkey", text.natural_key(F.expr("concat('take000', p_partkey, '123456789012345678901234')")).alias("sort_key"))
