"""Candidate segments of several kinds, weighed together, and the greedy choice among them.

Candidates: track (a project), source (a recording of it), start, duration, text.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import cut, drop

#: A segment shorter than this is never taken, and segments overlap from here on (seconds).
SHORTEST, OVERLAP = 0.35, 0.25
#: Rounds of locally best candidates; what is left after them is finished source by source.
ROUNDS = 24
MARKS = "?？!！"


@dataclass(frozen=True)
class Kind:
    """One set of candidates: its score, and what others gain by overlapping it."""

    name: str
    base: float
    bonus: float
    rows: DataFrame


def running_max(df: DataFrame, by: list[str], at: str, order: list[Column], values: dict[str, Column], span: float) -> DataFrame:
    """df with the largest of each value so far (in order of ``at`` and ``order``).
    A group is cut to stretches of ``span``, so one group is many tasks' work; the
    stretches before a row count by their largest values."""
    cut_at = df.withColumn("_s", F.floor(F.col(at) / span))
    tops = cut_at.groupBy(*by, "_s").agg(*[F.max(v).alias(f"_{k}") for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*by, "_s", *[F.max(f"_{k}").over(before).alias(f"_{k}") for k in values])
    here = Window.partitionBy(*by, "_s").orderBy(at, *order).rowsBetween(Window.unboundedPreceding, 0)
    inner = cut_at.withColumns({k: F.max(v).over(here) for k, v in values.items()})
    met = inner.join(carried, [*by, "_s"])
    return met.withColumns({k: F.greatest(k, f"_{k}") for k in values}).drop("_s", *[f"_{k}" for k in values])


def boost(text: Column, words: tuple[str, ...] = tx.DRAMA, marks: str = MARKS) -> Column:
    """7 for each word that the text holds and 4 if it holds a mark, 35 at most."""
    total = F.when(F.translate(text, marks, "") != text, 4.0).otherwise(0.0)
    for w in words:
        total = total + F.when(F.contains(text, F.lit(w)), 7.0).otherwise(0.0)
    return F.least(F.lit(35.0), total)


def weigh(kinds: list[Kind], clip: float, words: tuple[str, ...] = tx.DRAMA, marks: str = MARKS, span: float = 600.0) -> DataFrame:
    """All candidates with ``kind`` (its number), ``score``: the kind's base, the drama
    of the text, a bonus for each other kind that they overlap, and up to 5 for a
    duration near ``clip``.  Rows of no track or source are left out."""
    rows = None
    for k, kind in enumerate(kinds):
        own = kind.rows.select("track", "source", F.col("start").cast("double"), F.col("duration").cast("double"), F.coalesce("text", F.lit("")).alias("text"), F.lit(k).alias("kind"))
        rows = own if rows is None else rows.unionByName(own)
    end = F.col("start") + F.col("duration")
    # An overlap of OVERLAP or more is with the one, begun OVERLAP before this one's end, that ends last.
    long = F.col("duration") >= OVERLAP
    begins = rows.where(long).select("track", "source", F.col("start").alias("at"), F.lit(0).alias("asks"), "start", "duration", "text", "kind")
    asks = rows.select("track", "source", (end - OVERLAP).alias("at"), F.lit(1).alias("asks"), "start", "duration", "text", "kind")
    reach = {f"last{k}": F.when((F.col("asks") == 0) & (F.col("kind") == k), end) for k in range(len(kinds))}
    seen = running_max(begins.unionByName(asks), ["track", "source"], "at", [F.col("asks")], reach, span).where("asks = 1")
    score = F.element_at(F.array(*[F.lit(float(k.base)) for k in kinds]), F.col("kind") + 1) + boost(F.col("text"), words, marks)
    for k, kind in enumerate(kinds):
        score = score + F.when((F.col("kind") != k) & long & (F.col(f"last{k}") >= F.col("start") + OVERLAP), float(kind.bonus)).otherwise(0.0)
    score = score + F.greatest(F.lit(0.0), 5.0 - F.abs(F.col("duration") - clip))
    return seen.select("track", "source", "start", "duration", "text", "kind", score.alias("score"))


def near_any(segment: tuple[float, float], taken: list[tuple[float, float]], longest: float, gap: float) -> bool:
    """Whether a (start, end) overlaps one of the taken ones, sorted, or starts within gap of it."""
    s, e = segment
    at = bisect.bisect_left(taken, (s - max(longest, gap), -math.inf))
    while at < len(taken) and taken[at][0] < max(e, s + gap):
        x, y = taken[at]
        if min(e, y) - max(s, x) >= OVERLAP or abs(s - x) < gap:
            return True
        at += 1
    return False


def without_near(rows: DataFrame, by: list[str], order: list[Column], gap: float, rounds: int = ROUNDS, slot: float | None = None) -> DataFrame:
    """The rows (``by``, start, duration and others) that stay if each in turn, by
    ``order``, goes when it overlaps one that stayed, of the same group, by OVERLAP or
    starts within ``gap`` of it.

    In a round, rows that are the first of all in every time slot that they touch
    stay, and rows near one of them go; a group's slots are spread over tasks, and a
    slot has one row to compare with.  Rounds are few where scores vary; a score that
    only rises or falls along a source settles slot after slot, so after ``rounds``
    rounds what is left is settled in turn within each group.
    """
    slot = slot or gap
    left = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    columns, kept = left.columns, []
    turn = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("_id").alias("id"))
    end = F.col("start") + F.col("duration")
    for _ in range(rounds):
        touched = left.withColumn("_turn", turn).withColumn("_slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor(F.greatest(end, F.col("start") + gap) / slot))))
        first = touched.groupBy(*by, "_slot").agg(F.min("_turn").alias("_first"))
        met = touched.join(first, [*by, "_slot"])
        best = cut(met.groupBy("_id").agg(F.bool_and(F.col("_turn") == F.col("_first")).alias("all"), *[F.first(c).alias(c) for c in columns if c != "_id"]).where("all").select(*columns))
        kept.append(best)
        spots = best.select(*by, "_id", F.col("start").alias("x"), end.alias("y"))
        spots = spots.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("x") / slot), F.floor(F.greatest(F.col("y"), F.col("x") + gap) / slot)))).drop("_id")
        near = (F.least(end, "y") - F.greatest("start", "x") >= OVERLAP) | (F.abs(F.col("start") - F.col("x")) < gap)
        gone = touched.join(spots, [*by, "_slot"]).where(near).select("_id").distinct()
        was, left = left, cut(left.join(gone, "_id", "left_anti").join(best.select("_id"), "_id", "left_anti").select(*columns))
        drop(was)
        if left.isEmpty():
            break
    else:
        taken = left.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order, "_id")))

        def settle(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_k")
            longest, stays, so_far = float(group["duration"].max()), [], []
            for s, d in zip(group["start"], group["duration"], strict=True):
                ok = not near_any((s, s + d), so_far, longest, gap)
                stays.append(ok)
                if ok:
                    bisect.insort(so_far, (s, s + d))
            return group[stays].drop(columns="_k")

        kept.append(taken.groupBy(*by).applyInPandas(settle, left.schema))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.drop("_id")


def fuse(weighted: DataFrame, target: float, gap: float) -> DataFrame:
    """(track, nth, source, start, duration, kind, score, text): by falling score, ties
    by kind, source, start and duration, each candidate that is not near one already
    taken, until a track's durations reach ``target``; the last is cut to what is
    left.  nth counts by source and time."""
    order = [F.col("score").desc(), F.col("kind"), F.col("source"), F.col("start"), F.col("duration"), F.col("text")]
    turn = [-F.col("score"), *[F.col(c) for c in ("kind", "source", "start", "duration", "text")]]
    apart = without_near(weighted.where(F.col("duration") >= SHORTEST), ["track", "source"], turn, gap)
    by = Window.partitionBy("track").orderBy(*order)
    # Each takes SHORTEST or more, so no track has more than so many; the rest need not be sorted together.
    first = apart.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= math.ceil(target / SHORTEST) + 1)
    before = F.coalesce(F.sum("duration").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    taken = first.withColumn("_before", before).withColumn("duration", F.least("duration", F.lit(target) - F.col("_before"))).where(F.col("duration") >= SHORTEST)
    nth = F.row_number().over(Window.partitionBy("track").orderBy("source", "start"))
    return taken.select("track", nth.alias("nth"), "source", F.greatest("start", F.lit(0.0)).alias("start"), "duration", "kind", "score", "text")
