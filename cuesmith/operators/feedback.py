"""Reviews of publishing feedback: latest records, group statistics, health levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .medians import exact_medians


def latest_records(records: DataFrame, keys: list[str], import_id: str = "import_id", seq: str = "seq") -> DataFrame:
    """The newest record of each key: a larger import id wins, any wins over none,
    and between equals the later row.  The order is total, so one aggregate with
    map-side combining does what a fold over rows does."""
    rest = [c for c in records.columns if c not in keys]
    age = F.struct((F.coalesce(F.col(import_id), F.lit("")) != "").alias("has"), F.coalesce(F.col(import_id), F.lit("")).alias("id"), F.col(seq).alias("seq"))
    newest = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), age).alias("r"), F.min(seq).alias("first_seen"))
    return newest.select(*keys, "first_seen", *[F.col(f"r.{c}").alias(c) for c in rest])


def is_duplicate(flag: Column, status: Column) -> Column:
    return F.coalesce(flag == "yes", F.lit(False)) | F.coalesce(status == "rejected_duplicate", F.lit(False))


def review_counts(latest: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n): one count for each value of each dimension, from one
    pass over the records (grouping sets of single columns)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return latest.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def account_plays(latest: DataFrame, account: str, plays: str) -> DataFrame:
    return latest.groupBy(account).agg(F.sum(plays).alias("play_total"), F.count(plays).alias("play_count"), F.avg(plays).alias("play_avg"))


def number_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, min, median (middle two averaged) and max of each group; a group
    without values has a count of 0 and nulls."""
    ends = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    middle = exact_medians(df, by, value).select(F.struct(*by).alias("_g"), "middle")
    return ends.withColumn("_g", F.struct(*by)).join(middle, "_g", "left").select(*by, "n", "least", "middle", "most")


def calibration(df: DataFrame, duplicate: Column, value: str, least_duplicates: int = 5, least_normal: int = 10) -> DataFrame:
    """One row: both medians, or too few samples for them."""
    flagged = df.select(F.coalesce(duplicate, F.lit(False)).alias("dup"), F.col(value).alias("v"))
    of = lambda kind, c: F.max(F.when(F.col("dup") == kind, F.col(c)))
    both = exact_medians(flagged, ["dup"], "v").agg(F.coalesce(of(True, "n"), F.lit(0).cast("long")).alias("n_duplicate"), F.coalesce(of(False, "n"), F.lit(0).cast("long")).alias("n_normal"), of(True, "middle").alias("d"), of(False, "middle").alias("m"))
    enough = (F.col("n_duplicate") >= least_duplicates) & (F.col("n_normal") >= least_normal)
    return both.select("n_duplicate", "n_normal", enough.alias("enough"), F.when(enough, F.col("d")).alias("duplicate_median"), F.when(enough, F.col("m")).alias("normal_median"))


def top_recipes(df: DataFrame, recipe: str, plays: str, finish: str, top: int = 5, least: int = 1) -> DataFrame:
    """Recipes by mean finish rate, then mean plays, as rounded for display."""
    g = df.where(F.trim(recipe) != "").groupBy(F.trim(recipe).alias("recipe")).agg(F.count("*").alias("n"), F.round(F.avg(plays), 1).alias("avg_play"), F.round(F.avg(finish), 4).alias("avg_finish"))
    return g.where(F.col("n") >= least).orderBy(F.desc("avg_finish"), F.desc("avg_play"), "recipe").limit(top)


def account_health(df: DataFrame, account: str, plays: str) -> DataFrame:
    """risk: 3 rows or more, 60 % of them without plays; warn: a mean under 100."""
    p = F.coalesce(F.col(plays), F.lit(0))
    g = df.where(F.trim(F.col(account).cast("string")) != "").groupBy(F.col(account).alias("account")).agg(F.count("*").alias("published"), F.count_if(p == 0).alias("zero"), F.sum(p).alias("plays"))
    mean = F.col("plays") / F.col("published")
    level = F.when((F.col("published") >= 3) & (F.col("zero") / F.col("published") >= 0.6), "risk").when(F.round(mean, 1) < 100, "warn").otherwise("ok")
    return g.select("account", "published", "zero", mean.alias("avg_play"), level.alias("level"))


#: Severity of the levels of checks.
SEVERITY = {"ok": 0, "warn": 1, "risk": 2}


def checklist(entries: DataFrame, rules: dict[str, tuple[Column, str]]) -> DataFrame:
    """(entry_id, rule, level): each rule's level where it is broken, else ok."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.when(broken, level).otherwise("ok").alias("level")) for n, (broken, level) in rules.items()]))
    return entries.select("entry_id", each.alias("c")).select("entry_id", "c.rule", "c.level")


def overall_level(checks: DataFrame, by: list[str]) -> DataFrame:
    rank = F.element_at(F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))]), F.col("level"))
    return checks.groupBy(*by).agg(F.max_by("level", rank).alias("level"))


def max_similarity(pairs: DataFrame) -> DataFrame:
    """(item, most, partner): over the pairs that touch an item; both ends count."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("left_id").alias("item"), F.col("right_id").alias("partner")), F.struct(F.col("right_id").alias("item"), F.col("left_id").alias("partner")))).alias("e"), "similarity")
    return ends.groupBy("e.item").agg(F.max(F.struct("similarity", (-F.col("e.partner")).alias("p"))).alias("m")).select("item", F.col("m.similarity").alias("most"), (-F.col("m.p")).alias("partner"))


def compare_versions(a_plays: Column, b_plays: Column, a_finish: Column, b_finish: Column) -> Column:
    """a or b by finish rate, then plays; tie."""
    a, b = F.struct(a_finish, a_plays), F.struct(b_finish, b_plays)
    return F.when(a > b, "a").when(a < b, "b").otherwise("tie")


def histogram(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts over a fixed domain, zero where there is none."""
    from .ledger import domain

    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(domain(df, values, column)).join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def latest_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")
