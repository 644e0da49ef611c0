"""Files that tools outside Spark read: CSV, subtitles, fixed-column tables, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import srt_timestamp

# The columns of tables that other tools read, in their order.
INVENTORY_COLUMNS = ("role", "path", "name", "suffix", "size_mb", "modified_at", "sha1")
PRODUCTION_COLUMNS = ("account_slot", "file", "source", "batch_id", "dedup_level", "similarity_status", "variant_border", "variant_zoom", "variant_speed", "variant_trim", "original_file")
PLAN_COLUMNS = ("镜号", "素材文件", "开始秒", "时长", "人物", "声音类型", "台词", "备注")
FEEDBACK_COLUMNS = ("account_slot", "file", "source", "batch_id", "dedup_level", "similarity_status", "platform", "publish_status", "publish_time", "publish_url", "play_count", "duplicate_flag", "fail_reason", "note")
SELECTION_COLUMNS = ("index", "line", "folder", "file", "score", "note")
SOUND_KIND = "原声/待配音"
#: Pairs that a report's readable view shows.
SHOWN = 80


def subtitle_text(cues: DataFrame, track: str) -> DataFrame:
    """(track, content): a track's cues as a subtitle file's text; cues without text
    are left out and the others numbered anew."""
    nth = F.row_number().over(Window.partitionBy(track).orderBy("start", "end"))
    rows = cues.where("trim(text) <> ''").withColumn("k", nth)
    block = F.format_string("%d\n%s --> %s\n%s\n", "k", srt_timestamp(F.col("start")), srt_timestamp(F.col("end")), F.trim("text"))
    blocks = rows.select(track, F.struct("k", block.alias("b")).alias("x")).groupBy(track).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return blocks.select(track, F.array_join(F.transform("xs", lambda x: x["b"]), "\n").alias("content"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "error", compression: str = "none") -> None:
    """CSV parts with a header; with an order, ranges of it part by part, so that the
    parts' names give the order and no single task sorts all."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).write.csv(path, header=True, mode=mode, escape='"', compression=compression)


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns first, then others by name; later writes only add parts."""
    extra = sorted(c for c in df.columns if c not in columns)
    df.select(*columns, *extra).write.csv(path, header=True, mode="append", escape='"')


def with_extras(df: DataFrame, columns: list[str], name: str = "extras") -> DataFrame:
    """Fixed columns and one map of all others, for rows with open columns."""
    rest = sorted(c for c in df.columns if c not in columns)
    pairs = [x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return df.select(*columns, (F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.lit(None).cast("map<string,string>")).alias(name))


def plan_rows(segments: DataFrame, unmatched_audio: DataFrame, unmatched_video: DataFrame) -> DataFrame:
    """Segments, leftovers of both sides and a summary of strategies in one table
    with a row_type; columns that a type lacks are null."""
    parts = [segments.withColumn("row_type", F.lit("segment")), unmatched_audio.withColumn("row_type", F.lit("unmatched_audio")), unmatched_video.withColumn("row_type", F.lit("unmatched_video"))]
    parts.append(segments.groupBy("strategy").agg(F.count("*").alias("n"), F.sum("duration").alias("duration")).withColumn("row_type", F.lit("summary")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def archive_document(parts: dict[str, DataFrame], spark_frame: DataFrame) -> DataFrame:
    """One JSON row with a digest (row count) of each part and the missing ones'
    names; a part's rows stay in its own table."""
    counts = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    doc = F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "rows"))))
    missing = F.array_sort(F.collect_list(F.when(F.col("rows") == 0, F.col("part"))))
    return counts.agg(F.to_json(F.struct(doc.alias("parts"), missing.alias("missing"))).alias("document"))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def inventory_table(files: DataFrame) -> DataFrame:
    """tables.inventory's rows in the inventory's columns, times to the second."""
    return files.withColumn("modified_at", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")).select(*INVENTORY_COLUMNS)


def production_table(copies: DataFrame) -> DataFrame:
    """The production list of copied files: file, original, dedup_level,
    similarity_status and the manifest's columns; what the manifest lacks is blank,
    a missing source is the original, a missing batch the original's folder."""
    t = lambda c: _text(copies, c)
    folder = F.regexp_extract("original", r"([^/]*)/[^/]*$", 1)
    values = [
        t("account_slot"), t("file"), F.coalesce(F.col("source"), F.col("original")), F.coalesce(F.col("batch_id").cast("string"), folder), t("dedup_level"), t("similarity_status"),
        t("dedup_border_style"), t("dedup_zoom_path"), t("dedup_speed_factor"), F.concat(t("dedup_intro_trim"), F.lit("/"), t("dedup_outro_trim")), t("original"),
    ]
    return copies.select(*[v.alias(c) for v, c in zip(values, PRODUCTION_COLUMNS, strict=True)])


def cut_plan(segments: DataFrame, plan: str) -> DataFrame:
    """A plan's segments (source, start, duration, text, reason) by source and start,
    numbered S001 on, in the columns of a cut plan."""
    nth = F.row_number().over(Window.partitionBy(plan).orderBy("source", "start"))
    three = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    values = [F.format_string("S%03d", nth), F.col("source"), three("start"), three("duration"), F.lit(""), F.lit(SOUND_KIND), _text(segments, "text"), _text(segments, "reason")]
    return segments.select(plan, *[v.alias(c) for v, c in zip(values, PLAN_COLUMNS, strict=True)])


def feedback_template(production: DataFrame) -> DataFrame:
    """A production list's rows with the columns of feedback still blank."""
    name = F.regexp_extract(F.trim(_text(production, "file")), r"([^/]*)$", 1)
    prefilled = {"account_slot", "source", "batch_id", "dedup_level", "similarity_status"}
    return production.select(*[(name if c == "file" else _text(production, c) if c in prefilled else F.lit("")).alias(c) for c in FEEDBACK_COLUMNS])


def selection_table(shots: DataFrame) -> DataFrame:
    """Chosen files of a script's lines, scores to three places."""
    return shots.withColumn("score", F.format_string("%.3f", F.col("score").cast("double"))).select(*SELECTION_COLUMNS)


def reusable_selections(saved: DataFrame, lines: DataFrame, files: DataFrame, track: str) -> DataFrame:
    """The saved rows (track, file, ...) of tracks whose choice can be used again:
    as many rows as the track has lines now (track, lines), and every file there (file)."""
    there = files.select("file", F.lit(True).alias("_there")).distinct()
    counts = saved.join(there, "file", "left").groupBy(track).agg(F.count("*").alias("_n"), F.bool_and(F.coalesce("_there", F.lit(False))).alias("_all"))
    good = counts.join(lines, track).where("_all AND _n = lines").select(track)
    return saved.join(good, track, "left_semi")


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as lines of a Markdown table, without its head."""
    cells = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[|\r\n]", " "), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def write_triplet(df: DataFrame, folder: str, name: str, columns: list[str]) -> None:
    """A report as JSON lines, as CSV and as a readable table: three folders of parts."""
    table = df.select(*columns)
    table.write.json(f"{folder}/{name}.json")
    write_csv(table, f"{folder}/{name}.csv")
    head = df.sparkSession.range(1).select(F.explode(F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("| " + " | ".join("---" for _ in columns) + " |"))).alias("line"))
    markdown(table, columns).write.text(f"{folder}/{name}.md")
    head.write.text(f"{folder}/{name}.md.head")


def top_pairs(pairs: DataFrame, most: int = SHOWN) -> DataFrame:
    """The most similar pairs, for reading: a report's top rows by similarity, then names."""
    return pairs.orderBy(F.desc("similarity"), "left_id", "right_id").limit(most)


def similarity_report(items: DataFrame, pairs: DataFrame, threshold: float, sound: Callable[[], DataFrame] | None = None) -> DataFrame:
    """One row: threshold, videos, pairs, high_similarity, audio_pairs, audio_high and
    audio_error.  Sound is asked for in its own job; if that fails, the report
    holds the error in place of its figures."""
    counts = items.agg(F.count("*").alias("videos")).crossJoin(pairs.agg(F.count("*").alias("pairs"), F.count_if(F.col("level") == "high").alias("high_similarity")))  # one row each
    figures, error = (None, None), None
    if sound is not None:
        try:
            figures = tuple(sound().agg(F.count("*"), F.count_if(F.col("level") == "high")).first())
        except Exception as e:  # whatever the sound's source raises is the report's to tell
            error = f"{type(e).__name__}: {e}".split("\n")[0]
    audio = [F.lit(figures[0]).cast("long").alias("audio_pairs"), F.lit(figures[1]).cast("long").alias("audio_high"), F.lit(error).cast("string").alias("audio_error")]
    return counts.select(F.lit(threshold).alias("threshold"), "*", *audio)


def write_similarity_report(items: DataFrame, pairs: DataFrame, folder: str, threshold: float, sound: Callable[[], DataFrame] | None = None) -> None:
    """summary.json, pairs.json, pairs.csv and the top pairs as a table, under folder; all
    pairs are listed, as gzip files."""
    similarity_report(items, pairs, threshold, sound).write.json(f"{folder}/summary.json")
    pairs.write.json(f"{folder}/pairs.json", compression="gzip")
    write_csv(pairs.select("left_id", "right_id", "similarity", "level"), f"{folder}/pairs.csv", compression="gzip")
    markdown(top_pairs(pairs).withColumn("similarity", F.format_string("%.4f", "similarity")), ["similarity", "level", "left_id", "right_id"]).write.text(f"{folder}/pairs.md")
