"""Timeline and interval operators over conversations (turns as lines, text lengths
as milliseconds) and events (a user's recording, microseconds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import matching as mt
from ..operators import timeline as op
from .registry import query, table

AT = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01', ts)"
AT_SQL = "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("duration"))


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(AT).alias("at"), "event_type", "value")


def spans(spark, sf_dir):
    """Silences: from each event of a user for up to ten minutes, in whole seconds."""
    return events(spark, sf_dir).select("user_id", F.expr("CAST(at div 1000000 AS DOUBLE)").alias("start"), F.expr("CAST(at div 1000000 + 60 + event_id % 540 AS DOUBLE)").alias("end"), F.lit(2678400.0).alias("total"))


SPANS = f"spans AS (SELECT user_id, CAST(({AT_SQL}) // 1000000 AS DOUBLE) AS \"start\", CAST(({AT_SQL}) // 1000000 + 60 + event_id % 540 AS DOUBLE) AS \"end\", 2678400.0::DOUBLE AS total FROM events)"


@query("t02_prefix_timeline", 'SELECT conv_id, turn, duration, CAST(e AS BIGINT) AS "end", CAST(e - duration AS BIGINT) AS start FROM (SELECT conv_id, turn, length(text) AS duration, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations)')
def prefix_timeline(spark, sf_dir):
    return op.prefix_timeline(lines(spark, sf_dir), "conv_id", "turn", "duration")


@query("a12_total_duration", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS total FROM conversations GROUP BY conv_id")
def total_duration(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("conv_id").agg(F.sum("duration").alias("total"))


@query("t05_even_split", "SELECT conv_id, turn, CAST(CASE WHEN k = n THEN 10000 - 10000 // n * (n - 1) ELSE 10000 // n END AS BIGINT) AS duration FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)")
def even_split(spark, sf_dir):
    return op.even_split(lines(spark, sf_dir).drop("duration").withColumn("total", F.lit(10000)), "conv_id", "turn", "total").select("conv_id", "turn", F.col("duration").cast("long").alias("duration"))


@query("t04_quantise_frames", "WITH f AS (SELECT conv_id, turn, greatest(1, CAST(round_even(length(text) / 100.0::DOUBLE * 25, 0) AS BIGINT)) AS frames, CAST(round_even(sum(length(text)) OVER (PARTITION BY conv_id) / 100.0::DOUBLE * 25, 0) AS BIGINT) AS whole, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, CASE WHEN k = 1 THEN CAST(whole - (sum(frames) OVER (PARTITION BY conv_id) - frames) AS BIGINT) ELSE frames END AS frames FROM f")
def quantise_frames(spark, sf_dir):
    d = lines(spark, sf_dir).withColumn("seconds", F.col("duration") / 100.0)
    total = d.groupBy("conv_id").agg((F.sum("duration") / 100.0).alias("total"))
    return op.quantise_frames(d.join(total, "conv_id"), "conv_id", "turn", "seconds", 25, "total")


#: Cues of a conversation's turns with gaps after some, and lines of other lengths on them.
_QUOTAS = """WITH d AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS DOUBLE) AS total FROM conversations),
c AS (SELECT conv_id, CAST(e - n AS DOUBLE) AS s, CAST(e - n % 5 AS DOUBLE) AS t, n, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM d WHERE n > 0),
w AS (SELECT conv_id, max(cum) AS whole, max_by(t, cum) AS last FROM c GROUP BY conv_id),
q AS (SELECT d.conv_id, d.turn, d.total, w.last, greatest(1, CAST(round_even(w.whole * (d.n % 37 + 1) / CAST(sum(d.n % 37 + 1) OVER (PARTITION BY d.conv_id) AS DOUBLE), 0) AS BIGINT)) AS quota FROM d JOIN w USING (conv_id)),
x AS (SELECT *, sum(quota) OVER (PARTITION BY conv_id ORDER BY turn) AS want, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM q),
b AS (SELECT x.conv_id, x.turn, x.total, x.k, CASE WHEN x.k = 1 THEN x.total ELSE least(x.total, CASE WHEN c.cum IS NULL THEN x.last WHEN x.want = c.cum THEN c.t ELSE c.s + CAST(x.want - (c.cum - c.n) AS DOUBLE) / c.n * (c.t - c.s) END) END AS stop
  FROM x LEFT JOIN c ON c.conv_id = x.conv_id AND x.want <= c.cum AND x.want > c.cum - c.n),
m AS (SELECT *, max(stop) OVER (PARTITION BY conv_id ORDER BY turn) AS reach FROM b),
r AS (SELECT conv_id, turn, total, k, round_even(reach - lag(reach, 1, 0.0) OVER (PARTITION BY conv_id ORDER BY turn), 3) AS duration FROM m)
SELECT conv_id, turn AS "index", CASE WHEN k = 1 THEN round_even(duration + round_even(total - sum(duration) OVER (PARTITION BY conv_id), 3), 3) ELSE duration END AS duration FROM r"""


@query("t03_quota_durations", _QUOTAS)
def quota_durations(spark, sf_dir):
    d = lines(spark, sf_dir)
    cues = op.prefix_timeline(d.withColumn("chars", F.col("duration") + 0), "conv_id", "turn", "duration").select("conv_id", F.col("start").cast("double").alias("start"), (F.col("end") - F.col("chars") % 5).cast("double").alias("end"), "chars")
    total = d.groupBy("conv_id").agg(F.sum("duration").cast("double").alias("total"))
    own = d.select("conv_id", F.col("turn").alias("index"), (F.col("duration") % 37 + 1).alias("chars")).join(total, "conv_id")
    return op.quota_durations(own, cues, "conv_id")


@query("f04_floor_violations", "SELECT conv_id, turn FROM conversations WHERE length(text) < 50")
def floor_violations(spark, sf_dir):
    return lines(spark, sf_dir).where("duration < 50").select("conv_id", "turn")


_POINTS = f"p AS (SELECT user_id, CAST(({AT_SQL}) // 1000000 AS DOUBLE) AS t FROM events), m AS (SELECT user_id, t FROM p WHERE t > 0 AND t < 2678400 UNION SELECT user_id, 0.0 FROM p UNION SELECT user_id, 2678400.0 FROM p), sp AS (SELECT user_id, t AS \"start\", lead(t) OVER (PARTITION BY user_id ORDER BY t) AS \"end\" FROM m)"


def _scenes(spark, sf_dir):
    p = events(spark, sf_dir).select("user_id", F.expr("CAST(at div 1000000 AS DOUBLE)").alias("t"), F.lit(2678400.0).alias("total"))
    return op.spans_from_points(p, "user_id", "t", "total")


@query("t06_spans_from_points", f'WITH {_POINTS} SELECT user_id, "start", "end" FROM sp WHERE "end" - "start" > 0.01')
def spans_from_points(spark, sf_dir):
    return _scenes(spark, sf_dir)


@query("t07_merge_short", f'WITH {_POINTS}, i AS (SELECT *, greatest(1, sum(CASE WHEN "end" - "start" >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start")) AS g FROM sp WHERE "end" - "start" > 0.01) SELECT user_id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY user_id, g')
def merge_short(spark, sf_dir):
    return op.merge_short(_scenes(spark, sf_dir), "user_id", 3600.0)


_COMPLEMENT = f"""WITH {SPANS}, g AS (SELECT user_id, coalesce(max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, "start", total FROM spans),
x AS (SELECT user_id, greatest(r - CASE WHEN r > 0 THEN 5 ELSE 0 END, 0) AS a, least("start" + 5, total) AS b FROM g UNION ALL SELECT user_id, greatest(max("end") - 5, 0), max(total) FROM spans GROUP BY user_id)"""


@query("u04_complement", _COMPLEMENT + ' SELECT user_id, a AS "start", b AS "end" FROM x WHERE b - a >= 30')
def complement(spark, sf_dir):
    return op.complement(spans(spark, sf_dir), "user_id", "total", 5.0, 30.0)


@query("u06_split_long", _COMPLEMENT + ', y AS (SELECT user_id, a, b FROM x WHERE b - a >= 30), z AS (SELECT user_id, a + 7200 * k AS "start", least(a + 7200 * (k + 1), b) AS "end" FROM (SELECT user_id, a, b, unnest(range(greatest(CAST(ceil((b - a) / 7200) AS BIGINT), 1))) AS k FROM y)) SELECT user_id, "start", "end" FROM z WHERE "end" - "start" >= 60')
def split_long(spark, sf_dir):
    return op.split_long(op.complement(spans(spark, sf_dir), "user_id", "total", 5.0, 30.0), 7200.0, 60.0)


@query("j17_overlapping", f"WITH {SPANS}, l AS (SELECT event_id, user_id, CAST(({AT_SQL}) // 1000000 AS DOUBLE) AS s, CAST(({AT_SQL}) // 1000000 + 300 AS DOUBLE) AS e FROM events WHERE event_type = 'view'), r AS (SELECT user_id, CAST(({AT_SQL}) // 1000000 AS DOUBLE) AS s, CAST(({AT_SQL}) // 1000000 + 600 AS DOUBLE) AS e FROM events WHERE event_type = 'click') SELECT event_id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND least(l.e, r.e) - greatest(l.s, r.s) >= 60)")
def overlapping(spark, sf_dir):
    cut = lambda kind, n: events(spark, sf_dir).where(F.col("event_type") == kind).select("event_id", "user_id", F.expr("CAST(at div 1000000 AS DOUBLE)").alias("start"), F.expr(f"CAST(at div 1000000 + {n} AS DOUBLE)").alias("end"))
    return op.overlapping(cut("view", 300), cut("click", 600).drop("event_id"), "user_id", 60.0, 3600.0).select("event_id")


@query("t08_voiced_runs", f"WITH n AS (SELECT user_id, event_id, value > 30 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), r AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE v) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, g")
def voiced_runs(spark, sf_dir):
    return op.islands(events(spark, sf_dir), "user_id", "event_id", F.col("value") > 30)


@query("t12_recent_rate", f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {AT_SQL} RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events")
def recent_rate(spark, sf_dir):
    return op.trailing_count(events(spark, sf_dir), "user_id", "at", 3600).select("event_id", "recent")


@query("t13_moving_mean", "SELECT event_id, avg(floor(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean FROM events")
def moving_mean(spark, sf_dir):
    return op.moving_mean(events(spark, sf_dir).withColumn("value", F.floor("value")), "user_id", ["at", "event_id"], "value", 100).select("event_id", "mean")


@query("t10_tumbling_mean", f"SELECT user_id, CAST(floor(({AT_SQL}) / 86400000000) AS BIGINT) AS bucket, avg(floor(value)) AS mean, count(*) AS n FROM events WHERE floor(value) > 5 GROUP BY 1, 2")
def tumbling_mean(spark, sf_dir):
    return op.tumbling_mean(events(spark, sf_dir).withColumn("value", F.floor("value")), "user_id", "at", 86400, "value", 5)


@query("j18_zip_rows", "WITH a AS (SELECT conv_id, turn AS a_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn AS b_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant') SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.place, b.place) AS place, a_turn, b_turn FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.place = b.place")
def zip_rows(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = op.zip_rows(c.where("role = 'user'").select("conv_id", F.col("turn").alias("a_turn")), c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("b_turn")), "conv_id", "a_turn", "b_turn")
    return r.select("conv_id", F.col("place").cast("long").alias("place"), "a_turn", "b_turn")


@query("t20_idle_spells", f"SELECT user_id, since, until FROM (SELECT user_id, {AT_SQL} AS since, lead({AT_SQL}) OVER (PARTITION BY user_id ORDER BY {AT_SQL}) AS until FROM events) WHERE until - since >= 43200000000")
def idle_spells(spark, sf_dir):
    return op.idle_spells(events(spark, sf_dir), "user_id", "at", 43_200_000_000)


@query("t17_budgeted", "SELECT conv_id, turn, CAST(b AS BIGINT) AS start, least(d, 400 - CAST(b AS BIGINT)) AS taken FROM (SELECT conv_id, turn, length(text) AS d, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 400")
def budgeted(spark, sf_dir):
    r = op.budgeted(lines(spark, sf_dir), "conv_id", "turn", "duration", 400)
    return r.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("taken").cast("long").alias("taken"))


@query("t17_round_robin", "SELECT conv_id, turn, CASE WHEN role <> 'user' THEN CAST((m - 1) % 3 AS BIGINT) END AS source_no FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS m FROM conversations)")
def round_robin(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return op.round_robin(c, "conv_id", "turn", F.col("role") == "user", 3).select("conv_id", "turn", F.col("source_no").cast("long").alias("source_no"))


#: Candidates in turn by falling score, with the list of those taken so far.
_GREEDY = f"""WITH RECURSIVE c AS (SELECT user_id, s, e, v, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, s, e) AS k FROM (SELECT user_id, CAST(({AT_SQL}) // 1000000 AS DOUBLE) AS s, CAST(({AT_SQL}) // 1000000 + 30 + event_id % 90 AS DOUBLE) AS e, value AS v FROM events)),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s DOUBLE, e DOUBLE, v DOUBLE)[]) AS taken, CAST(600 AS DOUBLE) AS left_ FROM (SELECT DISTINCT user_id FROM c)
UNION ALL SELECT user_id, k, CASE WHEN ok THEN list_append(taken, CAST({{'s': s, 'e': least(e, s + left_), 'v': v}} AS STRUCT(s DOUBLE, e DOUBLE, v DOUBLE))) ELSE taken END, CASE WHEN ok THEN left_ - least(e - s, left_) ELSE left_ END
  FROM (SELECT r.user_id, c.k, c.s, c.e, c.v, r.taken, r.left_, len(list_filter(r.taken, lambda x: least(c.e, x.e) - greatest(c.s, x.s) >= 0.25 OR abs(c.s - x.s) < 900)) = 0 AS ok FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1 WHERE r.left_ > 0)),
z AS (SELECT user_id, unnest(max_by(taken, k)) AS t FROM r GROUP BY user_id)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t.s, t.e) AS nth, t.s AS start, t.e AS "end", t.v AS score FROM z"""


@query("r03_greedy_pick", _GREEDY)
def greedy_pick(spark, sf_dir):
    c = events(spark, sf_dir).select("user_id", F.expr("CAST(at div 1000000 AS DOUBLE)").alias("start"), F.expr("CAST(at div 1000000 + 30 + event_id % 90 AS DOUBLE)").alias("end"), F.col("value").alias("score"))
    return mt.greedy_pick(c, "user_id", "score", 600.0, 900.0)


@query("x15_fit_video", "SELECT o_orderkey, greatest(a, 0.01) AS target, CASE WHEN greatest(v, 0.01) >= greatest(a, 0.01) THEN 1.0 ELSE greatest(v, 0.01) / greatest(a, 0.01) END AS speed, CASE WHEN greatest(v, 0.01) >= greatest(a, 0.01) THEN greatest(a, 0.01) END AS trim_to FROM (SELECT o_orderkey, o_totalprice / 1000 AS v, CAST(o_orderkey % 300 AS DOUBLE) AS a FROM orders)")
def fit_video(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_totalprice / 1000").alias("v"), F.expr("CAST(o_orderkey % 300 AS DOUBLE)").alias("a"))
    target, speed, trim = times.fit_video(F.col("v"), F.col("a"), "trim")
    return o.select("o_orderkey", target.alias("target"), speed.alias("speed"), trim.alias("trim_to"))


@query("x15_sync_strategy", "SELECT o_orderkey, CASE WHEN abs(a - v) <= 0.1 THEN 'as_is' WHEN v > a THEN 'trim_tail' WHEN a - v <= a * 0.15 THEN 'slow' ELSE 'freeze' END AS strategy FROM (SELECT o_orderkey, o_totalprice / 1000 AS v, CAST(o_orderkey % 300 AS DOUBLE) AS a FROM orders)")
def sync_strategy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_totalprice / 1000").alias("v"), F.expr("CAST(o_orderkey % 300 AS DOUBLE)").alias("a"))
    return o.select("o_orderkey", times.sync_strategy(F.col("a"), F.col("v")).alias("strategy"))


@query("x16_timecodes", "SELECT event_id, CAST(h * 3600 + m * 60 + s AS DOUBLE) AS seconds FROM (SELECT event_id, event_id // 3600 AS h, event_id // 60 % 60 AS m, event_id % 60 AS s FROM events)")
def timecodes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("concat_ws(':', event_id div 3600, event_id div 60 % 60, event_id % 60)").alias("code"))
    return e.select("event_id", times.parse_timecode(F.col("code")).alias("seconds"))


@query("k03_srt_timestamps", "SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp FROM (SELECT event_id, event_id * 1237 AS ms FROM events)")
def srt_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.srt_timestamp(F.expr("event_id * 1237 / 1000")).alias("stamp"))


@query("x26_tempo_chain", "SELECT l_orderkey, l_linenumber, CASE WHEN s > 2 THEN [2.0::DOUBLE, round_even(s / 2, 4)] WHEN s < 0.5 THEN [0.5::DOUBLE, round_even(s / 0.5::DOUBLE, 4)] ELSE [round_even(s, 4)] END AS factors FROM (SELECT l_orderkey, l_linenumber, least(greatest(CAST(l_quantity AS DOUBLE) / 8, 0.25), 4.0) AS s FROM lineitem)")
def tempo_chain(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.tempo_chain(F.col("l_quantity").cast("double") / 8).alias("factors"))


@query("x26_strict_chain", "SELECT l_orderkey, l_linenumber, list_concat(CASE WHEN s > 100.001 THEN ['100.000000'] ELSE CAST([] AS VARCHAR[]) END, list_transform(range(d), lambda i: '0.500000'), CASE WHEN abs(r - 1) >= 0.001 THEN [printf('%.6f', r)] ELSE CAST([] AS VARCHAR[]) END) AS factors FROM (SELECT *, CASE WHEN s > 100.001 THEN s / 100 ELSE s * power(2, d) END AS r FROM (SELECT l_orderkey, l_linenumber, s, CASE WHEN s >= 0.499 THEN 0 WHEN s >= 0.2495 THEN 1 WHEN s >= 0.12475 THEN 2 WHEN s >= 0.062375 THEN 3 WHEN s >= 0.0311875 THEN 4 ELSE 5 END AS d FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DOUBLE) * 4 ELSE CAST(l_quantity AS DOUBLE) / 32 END AS s FROM lineitem)))")
def strict_chain(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", times.strict_tempo_chain(F.when(F.col("l_linenumber") % 2 == 0, q * 4).otherwise(q / 32)).alias("factors"))


@query("x17_publish_times", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS at FROM events")
def publish_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 2 THEN 'soon' WHEN event_id % 3 = 1 THEN date_format(ts, 'yyyy/MM/dd') ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END").alias("t"))
    return e.select("event_id", times.publish_time(F.col("t")).alias("at"))
