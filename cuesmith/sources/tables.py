"""Loosely structured files as tables: subtitles, CSV with aliases, JSON lists, folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import first_filled
from ..functions.times import parse_seconds


def cues_of(text: Column) -> Column:
    """array<struct<start, end, text>> of a subtitle file's text: blocks between
    blank lines that have a time line, an end after the start and some text."""
    blocks = F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n\s*\n", -1)
    times = r"(\d+:\d+(?::\d+)?[.,]\d+|\d+:\d+:\d+)\s*-->\s*(\d+:\d+(?::\d+)?[.,]\d+|\d+:\d+:\d+)"
    parse = lambda b, k: parse_seconds(F.regexp_extract(b, times, k), -1.0)
    body = lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, rf"(?s)^.*?{times}[^\n]*\n?", ""), r"\s*\n\s*", " "))
    cues = F.transform(F.filter(blocks, lambda b: b.rlike(times)), lambda b: F.struct(parse(b, 1).alias("start"), parse(b, 2).alias("end"), body(b).alias("text")))
    return F.filter(cues, lambda c: (c["end"] > c["start"]) & (c["start"] >= 0) & (c["text"] != ""))


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """(path, index, start, end, text) of all subtitle files under path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.srt").text(path, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.posexplode(cues_of(F.col("value"))).alias("index", "c"))
    return named.select("path", (F.col("index") + 1).alias("index"), "c.start", "c.end", "c.text")


def read_strings(spark: SparkSession, path: str, broken: str | None = None) -> DataFrame:
    """A CSV file with a header, all columns strings.  A line of too few or too many
    fields keeps what it has; with a name for it, the column ``broken`` holds such
    a line's text (null for the others)."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    if broken is None:
        return spark.read.csv(path, inferSchema=False, mode="PERMISSIVE", **options)
    names = spark.read.csv(path, **options).columns
    kinds = ", ".join(f"`{n}` string" for n in [*names, broken])
    return spark.read.schema(kinds).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=broken, **options)


def _filled(columns: list[str]) -> Column:
    """A row as a map of its columns that aren't blank."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "") if pairs else F.create_map().cast("map<string,string>")


def records(df: DataFrame) -> DataFrame:
    """(fields): each row as a map of its columns that aren't blank; blank rows go."""
    return df.select(_filled(df.columns).alias("fields")).where(F.size("fields") > 0)


def sheet_records(cells: DataFrame) -> DataFrame:
    """(path, row_number, fields): a workbook's rows under the headers of its first
    row, from read_workbooks' cells; blank rows and columns without a header go."""
    heads = cells.where("row_number = 1").select("path", "col", F.trim("value").alias("head"))
    own = cells.where("row_number > 1").join(heads, ["path", "col"]).where("trim(value) <> '' AND head <> ''")
    return own.groupBy("path", "row_number").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("head", "value")))).alias("fields"))


def read_labelled(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(label, fields, problem): the rows of several CSV files as maps.  A file that
    isn't there is one row with problem ``missing``, and a broken line one with
    ``parse_failed``; neither stops the read."""
    out = spark.createDataFrame([], "label string, fields map<string,string>, problem string")
    for label, path in paths.items():
        try:
            df = read_strings(spark, path, "_broken")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            own = spark.range(1).select(F.lit(label).alias("label"), F.lit(None).cast("map<string,string>").alias("fields"), F.lit("missing").alias("problem"))
        else:
            own = df.select(F.lit(label).alias("label"), _filled([c for c in df.columns if c != "_broken"]).alias("fields"), F.when(F.col("_broken").isNotNull(), "parse_failed").alias("problem"))
            own = own.where("size(fields) > 0 OR problem IS NOT NULL")
        out = out.unionByName(own)
    return out


def aliased(df: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """Logical columns, each from the first filled one of its headers."""
    return df.select(*[first_filled(df, names).alias(c) for c, names in columns.items()])


def read_cues_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cues of a CSV file; an end, or a start and a duration."""
    names = {"source": ["source", "file", "video"], "start": ["start", "start_seconds", "开始"], "end": ["end", "end_seconds", "结束"], "duration": ["duration", "时长"], "text": ["text", "字幕", "content"]}
    rows = aliased(read_strings(spark, path), names)
    start = parse_seconds(F.coalesce("start", F.lit("")), -1.0)
    end = F.coalesce(F.when(F.col("end").isNotNull(), parse_seconds(F.col("end"), -1.0)), start + parse_seconds(F.coalesce("duration", F.lit("")), -1.0))
    return rows.select("source", start.alias("start"), end.alias("end"), "text").where("start >= 0 AND end > start")


def read_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of a JSON list, or of an object's items, queue or rows.  item: their schema."""
    kind = f"array<struct<{item}>>"
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"items {kind}, queue {kind}, rows {kind}")
    rows = F.coalesce(F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)), wrapped["items"], wrapped["queue"], wrapped["rows"])
    return text.select(F.explode(rows).alias("r")).select("r.*")


def read_list(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of a snapshot that is a JSON list; any other document has none.  item: their schema."""
    text = spark.read.text(path, wholetext=True)
    return text.where(F.ltrim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<struct<{item}>>")).alias("r")).select("r.*")


def timings(rows: DataFrame) -> DataFrame:
    """(index, duration) of a timing table's rows, of which only the duration is
    trusted.  No rows, or one duration that is no positive number, fail the query
    whatever columns it goes on to use."""
    d = F.col("duration").try_cast("double")
    bad = F.count_if(F.coalesce(~(d > 0) | F.isnan(d), F.lit(True)))
    sound = rows.agg(F.when(F.count("*") == 0, F.raise_error(F.lit("empty timing table")).cast("boolean")).when(bad > 0, F.raise_error(F.lit("bad duration in a timing table")).cast("boolean")).otherwise(True).alias("sound"))
    return rows.where(sound.scalar()).select(F.col("index").try_cast("int").alias("index"), d.alias("duration"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    return timings(read_strings(spark, path))


def inventory(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), hash_limit: int = 80 << 20, with_hash: bool = False, role: str = "") -> DataFrame:
    """(role, path, name, suffix, size_mb, bytes, modified, sha1) of all files under
    path; sha1 only if asked for, and blank over the limit.  Contents are read only then."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    digest = F.when(F.col("length") <= hash_limit, F.sha1("content")).otherwise("") if with_hash else F.lit("")
    rows = files.select(F.lit(role).alias("role"), "path", name.alias("name"), suffix.alias("suffix"), F.bround(F.col("length") / (1 << 20), 3).alias("size_mb"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), digest.alias("sha1"))
    return rows.where(F.col("suffix").isin(*extensions)) if extensions else rows


def log_silences(log: Column) -> Column:
    """array<struct<start, end>> from a tool's log, starts and ends paired in order."""
    number = lambda word: F.transform(F.regexp_extract_all(log, F.lit(word + r":\s*(-?[0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))
    paired = F.arrays_zip(number("silence_start").alias("start"), number("silence_end").alias("end"))
    return F.filter(paired, lambda p: p["end"] > p["start"])


def newest(listing: DataFrame, by: list[str]) -> DataFrame:
    """The newest path of each group by (modified, path)."""
    return listing.groupBy(*by).agg(F.max(F.struct("modified", "path")).alias("m")).select(*by, "m.path")
