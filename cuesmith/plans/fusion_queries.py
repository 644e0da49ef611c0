"""Candidate segments weighed together and picked, over events as segments: a user's
two recordings of ten minutes, in quarters of seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion
from .registry import query, table
from .timeline_queries import AT, AT_SQL

# The kinds' scores and what overlapping them adds.
KINDS = (("click", 105, 28), ("purchase", 78, 18), ("view", 50, 8), ("error", 42, 6))
WORDS, CLIP, TARGET, GAP = ("ur", "er"), 4.0, 60.0, 3.0


def kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("track"), F.expr("concat('s', event_id % 2)").alias("source"), F.expr(f"({AT} div 1000000) % 2400 * 0.25D").alias("start"), F.expr("(event_id % 40 + 1) * 0.25D").alias("duration"), F.expr("CASE WHEN event_id % 3 = 0 THEN concat(event_type, '!?') ELSE event_type END").alias("text"))
    return [fusion.Kind(name, base, bonus, e.where(F.col("event_type") == name).drop("event_type")) for name, base, bonus in KINDS]


_CANDIDATES = f"""c AS (SELECT user_id AS track, 's' || (event_id % 2) AS source, (({AT_SQL}) // 1000000) % 2400 * 0.25::DOUBLE AS s, (event_id % 40 + 1) * 0.25::DOUBLE AS d,
  CASE WHEN event_id % 3 = 0 THEN event_type || '!?' ELSE event_type END AS text, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS kind FROM events WHERE event_type <> 'signup'),
f AS (SELECT track, source, s, d, text, kind, [EXISTS (SELECT 1 FROM c x WHERE x.track = c.track AND x.source = c.source AND x.kind = 0 AND least(x.s + x.d, c.s + c.d) - greatest(x.s, c.s) >= 0.25),
  EXISTS (SELECT 1 FROM c x WHERE x.track = c.track AND x.source = c.source AND x.kind = 1 AND least(x.s + x.d, c.s + c.d) - greatest(x.s, c.s) >= 0.25),
  EXISTS (SELECT 1 FROM c x WHERE x.track = c.track AND x.source = c.source AND x.kind = 2 AND least(x.s + x.d, c.s + c.d) - greatest(x.s, c.s) >= 0.25),
  EXISTS (SELECT 1 FROM c x WHERE x.track = c.track AND x.source = c.source AND x.kind = 3 AND least(x.s + x.d, c.s + c.d) - greatest(x.s, c.s) >= 0.25)] AS o FROM c),
w AS (SELECT track, source, s, d, text, kind, CAST([105, 78, 50, 42][kind + 1] + least(35, 7 * CAST(contains(text, 'ur') AS INTEGER) + 7 * CAST(contains(text, 'er') AS INTEGER) + 4 * CAST(contains(text, '?') OR contains(text, '!') AS INTEGER))
  + CASE WHEN kind <> 0 AND o[1] THEN 28 ELSE 0 END + CASE WHEN kind <> 1 AND o[2] THEN 18 ELSE 0 END + CASE WHEN kind <> 2 AND o[3] THEN 8 ELSE 0 END + CASE WHEN kind <> 3 AND o[4] THEN 6 ELSE 0 END AS DOUBLE) + greatest(0, 5 - abs(d - 4)) AS score FROM f)"""


@query("r03_weighted_union", f'WITH {_CANDIDATES} SELECT track, source, s AS start, d AS duration, text, CAST(kind AS INTEGER) AS kind, score FROM w')
def weighted_union(spark, sf_dir):
    return fusion.weigh(kinds(spark, sf_dir), CLIP, WORDS)


_TAKEN = "STRUCT(source VARCHAR, s DOUBLE, d DOUBLE, kind INTEGER, score DOUBLE, text VARCHAR)"


@query("r03_fusion", f"""WITH RECURSIVE {_CANDIDATES},
k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, kind, source, s, d, text) AS k FROM w WHERE d >= 0.35),
r AS (SELECT track, CAST(0 AS BIGINT) AS k, CAST([] AS {_TAKEN}[]) AS taken, CAST(60 AS DOUBLE) AS rest FROM (SELECT DISTINCT track FROM k)
UNION ALL SELECT track, k, CASE WHEN ok THEN list_append(taken, CAST({{'source': source, 's': s, 'd': least(d, rest), 'kind': kind, 'score': score, 'text': text}} AS {_TAKEN})) ELSE taken END, CASE WHEN ok THEN rest - least(d, rest) ELSE rest END
  FROM (SELECT r.track, k.k, k.source, k.s, k.d, k.kind, k.score, k.text, r.taken, r.rest, least(k.d, r.rest) >= 0.35 AND len(list_filter(r.taken, lambda x: x.source = k.source AND (least(k.s + k.d, x.s + x.d) - greatest(k.s, x.s) >= 0.25 OR abs(k.s - x.s) < 3))) = 0 AS ok
    FROM r JOIN k ON k.track = r.track AND k.k = r.k + 1 WHERE r.rest > 0)),
z AS (SELECT track, unnest(max_by(taken, k)) AS t FROM r GROUP BY track)
SELECT track, CAST(row_number() OVER (PARTITION BY track ORDER BY t.source, t.s) AS INTEGER) AS nth, t.source AS source, t.s AS start, t.d AS duration, t.kind AS kind, t.score AS score, t.text AS text FROM z""")
def fused(spark, sf_dir):
    return fusion.fuse(fusion.weigh(kinds(spark, sf_dir), CLIP, WORDS), TARGET, GAP)
