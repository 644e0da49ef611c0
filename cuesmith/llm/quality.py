"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text's statistics are array expressions within its row, so nothing but
(language, source) summaries is shuffled: KLL quantile sketches, which merge
across tasks, give each group its own fences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words.
BLANKS = " \t\n\v\f\r"
GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: ratio: its quantile, how many times the distance from the median to that quantile
#: its fence lies above it, and the least of that.  Symbols are not bounded by the base
#: rules, so junk may fill a tail; repeats are, and what is usual lies in their tail.
RATIOS = {"symbol_ratio": (0.75, 12.0, 0.05), "dup_line_ratio": (0.99, 0.5, 0.05), "repeat_ratio": (0.99, 0.5, 0.02)}
#: Word length is fenced at so many halves of its quartiles' distance from the median, each half LEAST_HALF at least.
HALVES, LEAST_HALF = 12.0, 0.05
#: A group's quantiles count by its rows, the whole table's as so many rows.
WHOLE_ROWS = 50
KLL_K = 1000
SALTS = 32


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every
    whole text (null: no words, all zero)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*[F.col(c) for c in (keep or [])], F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Trimmed by a list of characters: a pattern at the end would try a run of blanks from each of its places.
    words = F.split(F.btrim(F.col("_text"), F.lit(BLANKS)), GAP, -1)
    df = df.withColumn("_words", F.when(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>")))
    size = F.size("_words")
    at = lambda i, k: F.get(F.col("_words"), i + k)
    windows = F.transform(F.sequence(F.lit(0), size - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    df = df.withColumn("_windows", F.when(size > WINDOW, windows).otherwise(F.array().cast("array<long>")))
    df = df.withColumn("_again", F.size("_windows") > F.size(F.array_distinct("_windows")))
    # Only where a window comes twice: sort (window, place), keep the places whose neighbour has the same window.
    df = df.withColumn("_sorted", F.when(F.col("_again"), F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    same = lambda i, k: F.get(F.col("_sorted"), i)["w"] == F.get(F.col("_sorted"), i + k)["w"]
    df = df.withColumn(
        "_places",
        F.when(F.col("_again"), F.array_sort(F.transform(F.filter(F.transform("_sorted", lambda s, i: F.struct(s["i"].alias("p"), (F.coalesce(same(i, 1), F.lit(False)) | F.when(i > 0, same(i, -1)).otherwise(False)).alias("d"))), lambda x: x["d"]), lambda x: x["p"]))),
    )
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(
        *(keep or []),
        F.col("_id").alias("doc_id"),
        size.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", GAP, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
    )


def _ratios(stats: DataFrame) -> DataFrame:
    per = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    return stats.withColumn("symbol_ratio", per("n_symbols", "word_chars")).withColumn("dup_line_ratio", per("n_dup_lines", "_n_lines")).withColumn("repeat_ratio", per("n_repeat_words", "n_words")).withColumn("word_length", per("word_chars", "n_words"))


def _quantiles(rows: DataFrame, by: list[str]) -> DataFrame:
    """Quantiles of each group from sketches of the rows that pass the base rules."""
    wanted = {**{n: (0.5, x) for n, (x, _, _) in RATIOS.items()}, "word_length": (0.25, 0.5, 0.75)}
    sketched = rows.where("not base_failed").groupBy(*by).agg(F.count("*").alias("_rows"), *[F.kll_sketch_agg_double(F.col(n), F.lit(KLL_K)).alias(n) for n in wanted]).where("_rows > 0")
    return sketched.select(*by, "_rows", *[F.kll_sketch_get_quantile_double(F.col(n), F.lit(x)).alias(_at(n, x)) for n, xs in wanted.items() for x in xs])


def _at(name: str, x: float) -> str:
    return f"{name}_{round(100 * x)}"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, and the ratios judged.

    base_failed: n_words < 10 or 100 * n_repeat_words > 20 * n_words.  kept: not
    base_failed, and every ratio within its (language, source) group's fences,
    whose quantiles are drawn towards the whole table's by WHOLE_ROWS.  Null language
    or source is a group of its own; a null or empty text fails the base rules;
    repeated rows are judged alike; an empty table gives an empty result; other
    columns are ignored.
    """
    ratios = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "word_length"]
    return _judged(docs, id_col, text_col, lang_col, source_col, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *ratios)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns unchanged.  Rows carry
    their statistics and meet only the groups' few fences, so texts are not
    shuffled while the fences are small enough for Spark to broadcast."""
    return _judged(docs, id_col, text_col, lang_col, source_col, ["_row"]).where("kept").select("_row.*")


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, keep: list[str]) -> DataFrame:
    from .shared import cut

    by = ["_lang", "_source"]
    group = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(name)
    pick = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_body"), group(lang_col, "_lang"), group(source_col, "_source"), *[F.struct(*[F.col(c) for c in docs.columns]).alias(c) for c in keep])
    stats = _ratios(text_stats(pick, "_doc", "_body", [*by, *keep]))
    rows = cut(stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))))
    names = [*[_at(n, x) for n, (tail, _, _) in RATIOS.items() for x in (0.5, tail)], *[_at("word_length", x) for x in (0.25, 0.5, 0.75)]]
    # One group may hold a third of all rows: rows are dealt to SALTS parts of their group, and its one row of quantiles to each.
    # The quantiles are written first, so that the join is planned by their size.
    own = cut(_quantiles(rows, by)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)))
    whole = _quantiles(rows, []).select(F.struct(*names)).scalar()  # one row, as a subquery
    met = rows.join(own, [*by, "_salt"], "left")
    n = F.coalesce("_rows", F.lit(0))

    def q(name: str, x: float) -> Column:
        return (n * F.coalesce(F.col(_at(name, x)), F.lit(0.0)) + WHOLE_ROWS * whole[_at(name, x)]) / (n + WHOLE_ROWS)

    half = F.greatest((q("word_length", 0.75) - q("word_length", 0.25)) / 2, F.lit(LEAST_HALF))
    within = F.abs(F.col("word_length") - q("word_length", 0.5)) <= HALVES * half
    for name, (tail, times, least) in RATIOS.items():
        within = within & (F.col(name) <= q(name, tail) + F.greatest(F.lit(times) * (q(name, tail) - q(name, 0.5)), F.lit(least)))
    return met.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))
