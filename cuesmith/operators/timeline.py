"""Timelines and intervals: prefix sums, gaps, complements, runs, trailing rates.

Every window is partitioned by its track (a script, a recording, a user), so a
corpus of many tracks is spread; one track's rows are one task's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_timeline(df: DataFrame, track: str, order: str, duration: str) -> DataFrame:
    """start and end of each row when a track's rows follow one another."""
    w = Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("end", F.sum(duration).over(w)).withColumn("start", F.col("end") - F.col(duration))


def even_split(df: DataFrame, track: str, order: str, total: str) -> DataFrame:
    """Equal durations, rounded to milliseconds; the last takes what is left."""
    every, nth = Window.partitionBy(track), Window.partitionBy(track).orderBy(order)
    n, k = F.count("*").over(every), F.row_number().over(nth)
    share = F.floor(F.col(total) / n)
    return df.withColumn("duration", F.when(k == n, F.col(total) - share * (n - 1)).otherwise(share))


def quota_durations(lines: DataFrame, cues: DataFrame, track: str) -> DataFrame:
    """Durations of a track's lines by the time that their share of characters
    takes on its cues, in milliseconds; together they are the total.

    lines: track, index, chars, total (seconds); cues: track, start, end, chars.
    A line's quota is its share of the cues' characters as a whole number, 1 at
    least.  It ends where the cues' running characters reach the quotas so far:
    within a cue by their part of it, with a cue at that cue's end, so that the
    gap after it is the next line's; beyond the last cue at its end.  Ends never go
    back, and the last line ends at the total.  Cues without characters count for
    nothing; tracks without others give no rows.
    """
    by = Window.partitionBy(track)
    run = lambda order: by.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cued = cues.where("chars > 0").withColumn("cum", F.sum("chars").over(run("start"))).select(track, F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("chars").alias("c_chars"), "cum")
    whole = cued.groupBy(track).agg(F.max("cum").alias("all"), F.max_by("c_end", "cum").alias("c_last"))
    own = lines.withColumn("script", F.sum("chars").over(by)).join(whole, track)
    own = own.withColumn("quota", F.greatest(F.lit(1), F.bround(F.col("all") * F.col("chars") / F.col("script"))).cast("long"))
    own = own.withColumn("want", F.sum("quota").over(run("index"))).select(track, "index", "total", "want", "c_last")
    # Lines and cues in one order, from the end: a line's cue is the last one seen, the first to reach its quota.
    none = lambda kind: F.lit(None).cast(kind)
    cue = F.struct("c_start", "c_end", "c_chars", "cum")
    marks = cued.select(track, none(lines.schema["index"].dataType).alias("index"), none("double").alias("total"), none("double").alias("c_last"), F.col("cum").alias("at"), cue.alias("cue"))
    wanted = own.select(track, "index", F.col("total").cast("double").alias("total"), F.col("c_last").cast("double").alias("c_last"), F.col("want").alias("at"), none(marks.schema["cue"].dataType).alias("cue"))
    back = by.orderBy(F.desc("at"), F.col("cue").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = wanted.unionByName(marks).withColumn("cue", F.last("cue", ignorenulls=True).over(back)).where("index IS NOT NULL")
    met = met.select(track, "index", "total", F.col("at").alias("want"), "c_last", "cue.*")
    part = (F.col("want") - (F.col("cum") - F.col("c_chars"))) / F.col("c_chars")
    at = F.when(F.col("want") == F.col("cum"), F.col("c_end")).otherwise(F.col("c_start") + part * (F.col("c_end") - F.col("c_start")))
    ends = met.select(track, "index", "total", F.coalesce(at, F.col("c_last")).alias("stop"))
    is_last = F.row_number().over(by.orderBy(F.desc("index"))) == 1
    ends = ends.withColumn("is_last", is_last).withColumn("stop", F.when(F.col("is_last"), F.col("total")).otherwise(F.least("stop", "total")))
    ends = ends.withColumn("stop", F.greatest(F.max("stop").over(run("index")), F.lit(0.0)))
    before = F.lag("stop", 1, 0.0).over(by.orderBy("index"))
    timed = ends.withColumn("duration", F.bround(F.col("stop") - before, 3))
    drift = F.bround(F.col("total") - F.sum("duration").over(by), 3)
    return timed.select(track, "index", F.when(F.col("is_last"), F.bround(F.col("duration") + drift, 3)).otherwise(F.col("duration")).alias("duration"))


def quantise_frames(df: DataFrame, track: str, order: str, duration: str, fps: int, total: str) -> DataFrame:
    """Whole frames of each row: at least one each, summing to round(total * fps).
    Rows go to their nearest frame; the last takes the difference, and where that
    would leave it none, frames are taken from the longest rows, the earlier first.
    """

    def fix(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ignore_index=True)
        frames = [max(1, round(d * fps)) for d in group[duration]]
        frames[-1] += round(float(group[total].iloc[0]) * fps) - sum(frames)
        while frames[-1] < 1 and max(frames[:-1], default=0) > 1:
            frames[max(range(len(frames) - 1), key=lambda i: (frames[i], -i))] -= 1
            frames[-1] += 1
        return pd.DataFrame({track: group[track], order: group[order], "frames": frames})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(track, order, duration, total).groupBy(track).applyInPandas(fix, f"{track} {kinds[track]}, {order} {kinds[order]}, frames long")


def spans_from_points(points: DataFrame, track: str, point: str, duration: str, least: float = 0.01) -> DataFrame:
    """Spans between a track's cut points, its start and its end."""
    marks = points.groupBy(track).agg(F.max(duration).alias("d"), F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), F.collect_set(F.when((F.col(point) > 0) & (F.col(point) < F.col(duration)), F.col(point).cast("double"))), F.array(F.max(duration).cast("double"))))).alias("p"))
    spans = marks.where("d > 0").select(track, F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("start"), F.get("p", i).alias("end")))).alias("s")).select(track, "s.*")
    return spans.where(F.col("end") - F.col("start") > least)


def merge_short(spans: DataFrame, track: str, least: float) -> DataFrame:
    """Short spans join the span before them (islands that start at a long span);
    short ones at the very start join the first long one, or all become one."""
    w = Window.partitionBy(track).orderBy("start")
    island = F.sum(F.when(F.col("end") - F.col("start") >= least, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("island", F.greatest(island, F.lit(1))).groupBy(track, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(silences: DataFrame, track: str, duration: str, pad: float = 0.0, least: float = 0.35) -> DataFrame:
    """What a track has between its silences, each widened by pad on either side.
    Overlapping silences count as one."""
    w = Window.partitionBy(track).orderBy("start")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = silences.select(track, F.greatest(reach - (F.when(reach > 0, pad).otherwise(0.0)), F.lit(0.0)).alias("from"), F.least(F.col("start") + pad, F.col(duration)).alias("to"))
    tail = silences.groupBy(track).agg(F.max("end").alias("e"), F.max(duration).alias("d")).select(track, F.greatest(F.col("e") - pad, F.lit(0.0)).alias("from"), F.col("d").alias("to"))
    return gaps.unionByName(tail).where(F.col("to") - F.col("from") >= least).select(track, F.col("from").alias("start"), F.col("to").alias("end"))


def split_long(ranges: DataFrame, most: float, least: float = 0.25) -> DataFrame:
    """Ranges cut every `most`, without rests shorter than `least`."""
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("end") - F.col("start")) / most) - 1, F.lit(0)).cast("int")))
    cut = ranges.withColumn("k", k).withColumns({"a": F.col("start") + F.col("k") * most, "b": F.least(F.col("start") + (F.col("k") + 1) * most, "end")})
    keep = [c for c in ranges.columns if c not in ("start", "end")]
    return cut.where(F.col("b") - F.col("a") >= least).select(*keep, F.col("a").alias("start"), F.col("b").alias("end"))


def overlapping(left: DataFrame, right: DataFrame, key: str, least: float, bucket: float) -> DataFrame:
    """Rows of left that overlap a row of right of the same key by `least` or more.
    Both sides are dealt to the time buckets that they touch, so that a key's
    ranges are compared only near one another."""
    deal = lambda df: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    l, r = deal(left), deal(right).select(key, "_b", F.col("start").alias("_s"), F.col("end").alias("_e"))
    near = [F.least("end", "_e") - F.greatest("start", "_s") >= least]
    met = l.join(r, [l[key] == r[key], l["_b"] == r["_b"], *near], "left_semi")
    return met.drop("_b").distinct()


def islands(df: DataFrame, track: str, order: str, on: Column) -> DataFrame:
    """(track, first, last, n) of each run of neighbouring rows where on holds."""
    w = Window.partitionBy(track).orderBy(order)
    nth = df.select(track, order, F.coalesce(on, F.lit(False)).alias("on"), F.row_number().over(w).alias("k"))
    runs = nth.where("on").withColumn("g", F.col("k") - F.row_number().over(w))
    return runs.groupBy(track, "g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("g")


def trailing_count(df: DataFrame, track: str, at: str, seconds: int) -> DataFrame:
    """How many of a track's events lie in the `seconds` up to each (`at`: whole
    microseconds)."""
    w = Window.partitionBy(track).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def moving_mean(df: DataFrame, track: str, order: list[str], value: str, last: int) -> DataFrame:
    return df.withColumn("mean", F.avg(value).over(Window.partitionBy(track).orderBy(*order).rowsBetween(1 - last, 0)))


def tumbling_mean(df: DataFrame, track: str, at: str, seconds: int, value: str, floor: float) -> DataFrame:
    """Means of each time bucket, without values at or under the floor."""
    return df.where(F.col(value) > floor).groupBy(track, F.floor(F.col(at) / (seconds * 1_000_000)).alias("bucket")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def zip_rows(left: DataFrame, right: DataFrame, track: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides paired by their place in the track; a missing side is null."""
    l = left.withColumn("place", F.row_number().over(Window.partitionBy(track).orderBy(left_order)))
    r = right.withColumn("place", F.row_number().over(Window.partitionBy(track).orderBy(right_order)))
    return l.join(r, [track, "place"], "full_outer")


def idle_spells(df: DataFrame, track: str, at: str, least: int) -> DataFrame:
    """(track, since, until): gaps of `least` microseconds or more between events."""
    after = F.lead(at).over(Window.partitionBy(track).orderBy(at))
    return df.select(track, F.col(at).alias("since"), after.alias("until")).where(F.col("until") - F.col("since") >= least)


def budgeted(df: DataFrame, track: str, order: str, duration: str, budget: float) -> DataFrame:
    """Rows of a track until its running total reaches the budget; the last one
    is cut to what is left of it."""
    before = F.coalesce(F.sum(duration).over(Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("start", before).where(F.col("start") < budget).withColumn("taken", F.least(F.col(duration), F.lit(budget) - F.col("start")))


def round_robin(df: DataFrame, track: str, order: str, matched: Column, n: int) -> DataFrame:
    """Rows without a match get source numbers in turn; the counter moves only on them."""
    miss = F.when(matched, 0).otherwise(1)
    nth = F.sum(miss).over(Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    return df.withColumn("source_no", F.when(~matched, F.pmod(nth, F.lit(n))))


def phrase_times(phrases: DataFrame, entry: str, place: str, least: float = 0.4) -> DataFrame:
    """start and end of an entry's phrases, by their share of its characters, to the millisecond.
    Where all could have `least` seconds, each gets them: what the short ones
    gain is taken from the others in proportion to their surplus.

    phrases: entry, place (from 0), chars, start, end (of the entry).
    """
    by = Window.partitionBy(entry)
    span, n = F.col("end") - F.col("start"), F.count("*").over(by)
    d = phrases.withColumns({"n": n, "raw": span * F.col("chars") / F.sum("chars").over(by)})
    roomy = F.col("n") * least <= span + 1e-9
    d = d.withColumn("lifted", F.when(roomy, F.greatest(F.lit(least), F.col("raw"))).otherwise(F.col("raw")))
    d = d.withColumns({"over": F.sum("lifted").over(by) - span, "slack": F.sum(F.col("lifted") - least).over(by)})
    taken = F.when(roomy & (F.col("over") > 1e-9) & (F.col("slack") > 1e-9), F.col("over") * (F.col("lifted") - least) / F.col("slack")).otherwise(0.0)
    d = d.withColumn("d", F.col("lifted") - taken)
    till = F.col("start") + F.sum("d").over(by.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("stop", F.when(F.col(place) == F.col("n") - 1, F.col("end")).otherwise(F.least("end", till)))
    began = F.coalesce(F.lag("stop").over(by.orderBy(place)), F.col("start"))
    return d.withColumn("began", began).select(entry, place, F.bround("began", 3).alias("start"), F.bround("stop", 3).alias("end"))
