"""Joins by keys of falling priority, by place and by name.

A prioritised match takes, for each row, the first right row of the first key that
has one.  Each key is its own equi-join; the winners meet in one aggregate that
combines before it shuffles.  No step compares all rows with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prioritised_match(left: DataFrame, right: DataFrame, left_id: str, right_order: str, keys: list[tuple[Column, Column]], take: list[str]) -> DataFrame:
    """left with `take` columns of its match and key_no (from 1), null without one.
    Null or empty keys match nothing."""
    found = None
    for no, (lk, rk) in enumerate(keys, 1):
        l = left.select(left_id, lk.alias("_k")).where("_k is not null and _k <> ''")
        r = right.select(rk.alias("_k"), right_order, *take).where("_k is not null and _k <> ''")
        first = r.groupBy("_k").agg(F.min_by(F.struct(*take), right_order).alias("r"), F.min(right_order).alias("o"))
        part = l.join(first, "_k").select(left_id, F.struct(F.lit(no).alias("no"), "o", "r").alias("m"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy(left_id).agg(F.min_by("m", F.struct("m.no", "m.o")).alias("m"))
    return left.join(best, left_id, "left").select(left["*"], F.col("m.no").alias("key_no"), *[F.col(f"m.r.{c}").alias(c) for c in take])


def first_of_tables(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """Each key's row from the first table that has it, the first by order there."""
    every = None
    for no, t in enumerate(tables):
        part = t.withColumn("_no", F.lit(no))
        every = part if every is None else every.unionByName(part)
    rest = [c for c in every.columns if c not in (key, "_no")]
    return every.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_no", order)).alias("r")).select(key, "r.*")


def prefer_source(tables: list[DataFrame]) -> DataFrame:
    """The rows of the first table that has any."""
    every = None
    for no, t in enumerate(tables):
        part = t.withColumn("_no", F.lit(no))
        every = part if every is None else every.unionByName(part)
    first = every.agg(F.min("_no").alias("_no"))
    return every.join(F.broadcast(first), "_no", "left_semi").drop("_no")


def allocate(accounts: DataFrame, items: DataFrame, account_order: str, count: str, item_order: str, group: str, reuse: bool = False) -> DataFrame:
    """Each account of a group gets `count` of the group's items in turn; with reuse,
    items start again when they run out."""
    slots = accounts.withColumn("_s", F.explode(F.expr(f"sequence(1, {count})")))
    slots = slots.withColumn("slot", F.row_number().over(Window.partitionBy(group).orderBy(account_order, "_s")).cast("long")).drop("_s")
    nth = items.withColumns({"slot": F.row_number().over(Window.partitionBy(group).orderBy(item_order)).cast("long"), "_n": F.count("*").over(Window.partitionBy(group))})
    if not reuse:
        return slots.join(nth.drop("_n"), [group, "slot"])
    sizes = nth.groupBy(group).agg(F.max("_n").alias("_n"))
    at = slots.join(sizes, group).withColumn("_at", F.pmod(F.col("slot") - 1, F.col("_n")) + 1).drop("_n")
    return at.join(nth.select(group, F.col("slot").alias("_at"), *[c for c in items.columns if c != group]), [group, "_at"]).drop("_at")


def styled(items: DataFrame, item: str, styles: list[tuple[str, float]]) -> DataFrame:
    """Each item with each of a few fixed styles; score falls by the style's place."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("style"), F.lit(base - i).alias("score"), F.lit(i == 0).alias("selected")) for i, (n, base) in enumerate(styles)]))
    return items.select(item, each.alias("s")).select(item, "s.*")


def with_default(df: DataFrame, value: str, order: str, group: str, templates: list[str]) -> DataFrame:
    """value, or where it is null a template in turn by the row's place in its group."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    turn = F.get(F.array(*map(F.lit, templates)), F.pmod(nth, F.lit(len(templates))).cast("int"))
    return df.withColumn(value, F.coalesce(F.col(value), turn))


def remember_pairs(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """known and those rows of new whose keys it lacks."""
    return known.unionByName(new.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys))


def merge_status(queue: DataFrame, updates: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The queue after updates: of several for a key the last by seq; null values
    in an update leave what is there."""
    last = updates.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("u"))
    joined = queue.join(last, key, "left")
    return joined.select(*[F.coalesce(F.col(f"u.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in queue.columns])


def greedy_pick(candidates: DataFrame, track: str, score: str, duration_budget: float, least_gap: float, least_overlap: float = 0.25) -> DataFrame:
    """Segments of each track by falling score until the budget is full, leaving out
    those that overlap a picked one or start too near it; then in time order.

    candidates: track, start, end, score.  Order-dependent, so one track's
    candidates are one group; ties by start.
    """
    import pandas as pd

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([score, "start", "end"], ascending=[False, True, True])
        taken: list[tuple[float, float, float]] = []
        left = duration_budget
        for s, e, v in zip(group["start"], group["end"], group[score], strict=True):
            if left <= 0:
                break
            if all(min(e, y) - max(s, x) < least_overlap and abs(s - x) >= least_gap for x, y, _ in taken):
                taken.append((s, min(e, s + left), v))
                left -= min(e - s, left)
        taken.sort()
        return pd.DataFrame({track: [group[track].iloc[0]] * len(taken), "nth": range(1, len(taken) + 1), "start": [t[0] for t in taken], "end": [t[1] for t in taken], "score": [t[2] for t in taken]})

    kind = candidates.schema[track].dataType.simpleString()
    return candidates.groupBy(track).applyInPandas(pick, f"{track} {kind}, nth long, start double, end double, score double")
