"""Exact medians of groups of any size by narrowing.

Quantile sketches of a group's values (mergeable, of fixed size) give a short
stretch that must hold the middle ranks; a count of what lies below and within it
says where they are in it, and the next pass looks only at that stretch.  Each pass
leaves about a two-hundredth of the values; the last few are counted by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop

#: Values of a group that may be sorted together; quantiles and accuracy of a sketch.
LIMIT, GRID, ACCURACY = 100_000, 1000, 10_000
#: Groups that are broadcast to the values; more are joined by key.
MOST_GROUPS = 100_000


def _groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(groups) if groups.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else groups, "_g")


def _narrowed(rows: DataFrame, left: DataFrame) -> DataFrame:
    """One pass over the groups of left (_g, n, below, inside, lo, hi): the same with a
    shorter stretch, or with the two middle values as ``low`` and ``high``."""
    here = _groups(rows, left).where("v >= lo AND v <= hi")
    sketch = here.groupBy("_g").agg(F.percentile_approx("v", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("q"))
    k1, k2 = F.floor((F.col("n") - 1) / 2) - F.col("below"), F.floor(F.col("n") / 2) - F.col("below")
    spot = lambda k, move: F.floor(k * GRID / F.col("inside")).cast("int") + move  # noqa: E731  two steps beyond: a sketch errs by a tenth of one
    lo2 = F.when(spot(k1, -2) > 0, F.get("q", spot(k1, -2))).otherwise(F.col("lo"))
    hi2 = F.when(spot(k2, 3) < GRID, F.get("q", spot(k2, 3))).otherwise(F.col("hi"))
    tight = left.join(sketch, "_g").select("_g", "n", "below", lo2.alias("lo"), hi2.alias("hi"))
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    met = _groups(here.select("_g", "v"), tight).groupBy("_g", "n", "below", "lo", "hi").agg(
        F.count_if(v < lo).alias("under"), F.count_if((v >= lo) & (v <= hi)).alias("inside"), F.count_if(v == lo).alias("at_lo"), F.count_if(v == hi).alias("at_hi"),
        F.min(F.when(v > lo, v)).alias("above"), F.max(F.when(v < hi, v)).alias("beneath"),
    )
    first, second = k1 - F.col("under"), k2 - F.col("under")
    ends = F.col("inside") - F.col("at_hi")
    # One of the middle values is an end of the stretch: then the other is it too, or the next value.
    at_low, at_high = first < F.col("at_lo"), second >= ends
    low = F.when(at_low, lo).when(at_high, F.when(first >= ends, hi).otherwise(F.col("beneath")))
    high = F.when(at_low, F.when(second < F.col("at_lo"), lo).otherwise(F.col("above"))).when(at_high, hi)
    return met.select("_g", "n", (F.col("below") + F.col("under") + F.col("at_lo")).alias("below"), (ends - F.col("at_lo")).alias("inside"), F.col("above").alias("lo"), F.col("beneath").alias("hi"), low.alias("low"), high.alias("high"))


def exact_medians(df: DataFrame, by: list[str], value: str, limit: int = LIMIT) -> DataFrame:
    """(by, n, least, middle, most) of each group's values as doubles: the middle
    value, or the mean of the middle two.  Nulls don't count, NaN is the largest; a
    group of nulls alone has no row."""
    rows = df.select(F.struct(*(by or [F.lit(0).alias("all")])).alias("_g"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = cut(rows.groupBy("_g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
    none = F.lit(None).cast("double")
    now, was = ends.select("_g", "n", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.col("least").alias("lo"), F.col("most").alias("hi"), none.alias("low"), none.alias("high")), None
    while not (left := now.where((F.col("inside") > limit) & F.col("low").isNull())).isEmpty():
        now = cut(now.where((F.col("inside") <= limit) | F.col("low").isNotNull()).unionByName(_narrowed(rows, left.drop("low", "high"))))
        if was is not None:
            drop(was)
        was = now
    rest = now.where(F.col("low").isNull())
    counted = _groups(rows, rest).where("v >= lo AND v <= hi").groupBy("_g", "n", "below", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto + F.col("below"))
    holds = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("c") <= k)
    one, two = holds(F.floor((F.col("n") - 1) / 2)), holds(F.floor(F.col("n") / 2))
    found = ranked.groupBy("_g").agg(F.max(F.when(one, F.col("v"))).alias("low"), F.max(F.when(two, F.col("v"))).alias("high"))
    every = now.where(F.col("low").isNotNull()).select("_g", "low", "high").unionByName(found)
    middle: Column = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.col("low") + F.col("high")) / 2)
    return ends.join(every, "_g").select("_g.*", "n", "least", middle.alias("middle"), "most")
