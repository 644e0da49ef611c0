"""Normalisation of loosely typed rows: aliases, synonyms, tolerant numbers, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted words for publishing states and yes or no.
FEEDBACK_STATUS = {
    "published": ("published", "success", "ok", "done", "已发布", "成功", "发布成功"),
    "failed": ("failed", "error", "fail", "失败", "发布失败"),
    "rejected_duplicate": ("rejected_duplicate", "duplicate", "雷同", "判重", "搬运"),
    "pending": ("pending", "todo", "待发布", "未发布"),
}
DUPLICATE_FLAG = {"yes": ("yes", "y", "true", "1", "是"), "no": ("no", "n", "false", "0", "否")}


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def first_filled(df: DataFrame, aliases: list[str]) -> Column:
    """The first alias column with a non-blank value; absent columns don't count."""
    found = [blank_to_null(F.col(f"`{a}`")) for a in aliases if a in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def synonyms(value: Column, words: dict[str, tuple[str, ...]], keep: bool = False) -> Column:
    """The word's canonical form; others become null, or stay if asked to."""
    v = F.lower(F.trim(value))
    pairs = F.create_map(*[x for to, many in words.items() for w in many for x in (F.lit(w), F.lit(to))])
    return F.coalesce(F.try_element_at(pairs, v), blank_to_null(value)) if keep else F.try_element_at(pairs, v)


def parse_int(value: Column) -> Column:
    """Whole numbers, also as 5.0 or 1,200; null for other texts."""
    number = F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double")
    return F.when(number == F.floor(number), number.cast("long"))


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def row_errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that are broken, in order."""
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in checks.items()]))


# File extensions of a valid input.
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "flv", "wmv", "webm", "m4v", "ts", "mpg", "mpeg")


def row_verdict(path: Column, text: Column, exists: Column | None = None) -> Column:
    """The first rule that a spreadsheet row breaks, or ok."""
    extension = F.lower(F.regexp_extract(F.trim(path), r"\.([A-Za-z0-9]+)$", 1))
    rule = F.when(F.trim(F.coalesce(path, F.lit(""))) == "", "path_empty").when(F.trim(F.coalesce(text, F.lit(""))) == "", "text_empty").when(~extension.isin(*VIDEO_EXTENSIONS), "bad_extension")
    if exists is not None:
        rule = rule.when(~exists, "not_found")
    return rule.otherwise("ok")
