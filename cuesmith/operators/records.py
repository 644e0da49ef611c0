"""Operators on publishing records, file listings, sessions and their upkeep.

Lookups are equi-joins on a key or a basename whose winner is chosen by an
aggregate that combines before it shuffles; ranks are within a track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key


def basename(path: Column) -> Column:
    """A path's last part in lower case."""
    return F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))


def release_block(duration: Column, least: float = 1.0) -> Column:
    """Why a rendered file is held back; null if it may go, as one of unknown duration may."""
    return F.when(duration <= least, "too_short")


def next_actionable(items: DataFrame, track: str, index: str, start: Column, needs: Column) -> DataFrame:
    """(track, index): the first item that needs attention from start on, then from the front."""
    place = F.struct((F.col(index) < start).alias("again"), F.col(index))
    return items.where(needs).groupBy(track).agg(F.min_by(index, place).alias(index))


def valid_ladder(steps: Column, most: int = 16, longest: int = 16) -> Column:
    """Sorted distinct steps; null if there are none, too many, or one outside 1..most."""
    own = F.array_sort(F.array_distinct(steps))
    good = (F.size(own) > 0) & (F.size(own) <= longest) & F.forall(own, lambda x: F.coalesce(x.between(1, most), F.lit(False)))
    return F.when(good, own)


def manifest_report(df: DataFrame, needed: list[str], any_of: list[str]) -> DataFrame:
    """One row: needed headers that are missing, rows, and rows with none of any_of filled."""
    own = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in any_of if c in df.columns]
    missing = ",".join(c for c in needed if c not in df.columns)
    return df.agg(F.count("*").alias("n"), F.count_if(F.coalesce(*own, F.lit(None)).isNull()).alias("unfilled")).withColumn("missing", F.lit(missing))


def _grams(text: Column, n: int | Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))


def containing(short: DataFrame, long: DataFrame, n: int = 4) -> DataFrame:
    """(s, l) of the texts s of short and l of long (columns ``s`` and ``l``, distinct)
    where l contains s.

    A text longer than n meets long ones only through that of its grams of n
    characters which the fewest of them hold; a shorter one by itself, through the
    grams of its own length.
    """
    grams = lambda c, k: F.array_distinct(F.when(F.length(c) >= k, _grams(F.col(c), k)).otherwise(F.array().cast("array<string>")))
    asked = short.where(F.length("s") > 0).withColumn("gram", F.explode(F.when(F.length("s") >= n, grams("s", n)).otherwise(F.array("s"))))
    held = long.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*[grams("l", k) for k in range(1, n + 1)])))))
    held = held.join(asked.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count("*").alias("c"))
    # A gram that no long text holds rules the short one out.
    rarest = asked.join(counts, "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("r")).where("r.c > 0")
    return rarest.select("s", F.col("r.gram").alias("gram")).join(held, "gram").where(F.contains("l", F.col("s"))).select("s", "l")


def match_contained(tokens: DataFrame, names: DataFrame, token: str, name: str, order: str, stems: bool = False) -> DataFrame:
    """tokens with the name that each fits: the equal one, else the first by order
    that contains it, else null; several rows of one name count as its first.

    With ``stems``, letters' case and blanks around a token don't count, a name is
    also equal without its extension, and a name fits as well if the token contains
    it without that (names are matched without it there).
    """
    lowered = lambda c: F.lower(F.btrim(c, F.lit(" \t\n\v\f\r"))) if stems else F.col(c)
    stem = lambda c: F.when(F.locate(".", F.substr(c, F.lit(2))) > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(c) if stems else c
    once = names.groupBy(name).agg(F.min(order).alias("_o"))
    known = once.select(F.col(name).alias("_name"), "_o", (F.lower(name) if stems else F.col(name)).alias("_whole")).withColumn("_stem", stem(F.col("_whole")))
    asked = tokens.select(lowered(token).alias("s")).where("s <> ''").distinct()
    first = F.min(F.struct("_o", "_name"))
    equal = known.select("_o", "_name", F.explode(F.array_distinct(F.array("_whole", "_stem"))).alias("s")).join(asked, "s", "left_semi").groupBy("s").agg(first.alias("best"))
    rest = asked.join(equal, "s", "left_anti")
    by_stem = known.where("_stem <> ''").groupBy("_stem").agg(first.alias("best"))
    texts = by_stem.select(F.col("_stem").alias("l"))
    met = containing(rest, texts)
    if stems:
        back = containing(texts.withColumnRenamed("l", "s"), rest.withColumnRenamed("s", "l"))
        met = met.unionByName(back.select(F.col("l").alias("s"), F.col("s").alias("l"))).distinct()
    within = met.join(by_stem, F.col("l") == F.col("_stem")).groupBy("s").agg(F.min("best").alias("best"))
    found = equal.unionByName(within).select("s", F.col("best._name").alias(name))
    return tokens.withColumn("s", lowered(token)).join(found, "s", "left").drop("s")


def records_of(records: DataFrame, key: str, batch: Column, files: DataFrame, file: str) -> DataFrame:
    """Records of the batch or of one of its files, each once; two passes in place of a join by OR."""
    of_files = records.join(files.select(file).distinct(), file, "left_semi")
    return records.where(batch).unionByName(of_files).dropDuplicates([key])


def release_status(files: DataFrame, folders: list[tuple[str, DataFrame]], log: DataFrame, file: str, order: str) -> DataFrame:
    """A file's status: the last of the folders that holds it, else its newest log action, else unknown."""
    out = files
    for name, listing in folders:
        out = out.join(listing.select(file).distinct().withColumn(f"_{name}", F.lit(name)), file, "left")
    out = out.join(log.groupBy(file).agg(F.max_by("action", order).alias("_log")), file, "left")
    held = [F.col(f"_{name}") for name, _ in reversed(folders)]
    return out.select(*files.columns, F.coalesce(*held, "_log", F.lit("unknown")).alias("status"))


def trace(outputs: DataFrame, path: str, tables: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """outputs with what each table says of the same basename: its value in the
    first row by order.  tables: name to (table, path, value, order)."""
    out = outputs.withColumn("_name", basename(F.col(path)))
    for name, (df, own, value, order) in tables.items():
        first = df.groupBy(basename(F.col(own)).alias("_name")).agg(F.min_by(value, order).alias(name))
        out = out.join(first, "_name", "left")
    return out.drop("_name")


def account_slots(count: Column, labels: list[str]) -> Column:
    """Labels for so many copies; those past the given ones are A01, A02 and so on by place."""
    given = F.array(*map(F.lit, labels))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.coalesce(F.get(given, i - 1), F.concat(F.lit("A"), F.lpad(i.cast("string"), 2, "0"))))


def resolve_paths(wanted: DataFrame, listing: DataFrame, value: str, by_root: bool = False) -> DataFrame:
    """wanted with the listed path that each value names: the same path, else a
    direct child of the first root, else the shortest path of that basename, or with
    ``by_root`` the first by root and name.
    listing: path, root (number), depth (1: direct child)."""
    names = listing.select("path", "root", "depth", basename(F.col("path")).alias("_name"))
    met = wanted.select(value).distinct().withColumn("_name", basename(F.col(value))).join(names, "_name")
    kind = F.when(F.col("path") == F.col(value), 0).when(F.col("depth") == 1, 1).otherwise(2)
    place = F.struct(kind, F.when((kind == 1) | (F.lit(by_root) & (kind == 2)), F.col("root")).otherwise(0), F.when(F.lit(by_root), 0).otherwise(F.length("path")), "path")
    return wanted.join(met.groupBy(value).agg(F.min_by("path", place).alias("path")), value, "left")


def dir_totals(files: DataFrame, path: str, size: str) -> DataFrame:
    """(dir, files, bytes) of every folder with all that is below it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.where(F.contains(path, F.lit("/"))).select(F.explode(above).alias("dir"), size).groupBy("dir").agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def shuffled_pick(lines: DataFrame, files: DataFrame, track: str, order: str, file: str, seed: int) -> DataFrame:
    """Each line gets a file of its folder in a seeded order, none twice before all were used."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(track).cast("string"), F.col(file).cast("string")))
    nth = files.select(track, file, F.row_number().over(Window.partitionBy(track).orderBy(drawn, file)).alias("_at"))
    sizes = files.groupBy(track).agg(F.count("*").alias("_n"))
    uses = lines.withColumn("_k", F.row_number().over(Window.partitionBy(track).orderBy(order))).join(sizes, track)
    return uses.withColumn("_at", F.pmod(F.col("_k") - 1, F.col("_n")) + 1).join(nth, [track, "_at"]).drop("_at", "_k", "_n")


def cascade(candidates: DataFrame, track: str, strategy: str, least: dict[int, int]) -> DataFrame:
    """The rows of each track's first strategy, by number, that gives enough of them (one, if not said)."""
    need = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col(strategy)), F.lit(1))
    enough = candidates.groupBy(track, strategy).agg(F.count("*").alias("_n")).where(F.col("_n") >= need)
    return candidates.join(enough.groupBy(track).agg(F.min(strategy).alias(strategy)), [track, strategy], "left_semi")


def first_term(text: Column, terms: list[str]) -> Column:
    """struct<at, term> of the first forbidden term in lower-cased text, null without one."""
    low = F.lower(text)
    spots = F.array(*[F.struct(F.locate(t, low).alias("at"), F.lit(t).alias("term")) for t in terms])
    return F.array_min(F.filter(spots, lambda s: s["at"] > 0))


def split_reference(text: Column) -> Column:
    """Lines of a text with line feeds, else its clauses with the marks that end them."""
    parts = F.when(F.contains(text, F.lit("\n")), F.split(text, "\n")).otherwise(F.regexp_extract_all(text, F.lit("[^.!?,]+[.!?,]?"), F.lit(0)))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def edge_cuts(runs: DataFrame, track: str, least: int) -> DataFrame:
    """(track, head, tail, gap): where sound starts and ends by runs of `least`
    windows or more, and the longest rest between such runs."""
    long = runs.where(F.col("n") >= least)
    rest = F.col("first") - F.lag("last").over(Window.partitionBy(track).orderBy("first"))
    return long.withColumn("_rest", rest).groupBy(track).agg(F.min("first").alias("head"), F.max("last").alias("tail"), F.max("_rest").alias("gap"))


def near_previous(segments: DataFrame, track: str, least_overlap: float, least_gap: float) -> DataFrame:
    """Segments with whether they repeat the one before: overlap or start gap."""
    w = Window.partitionBy(track).orderBy("start", "end")
    s, e = F.lag("start").over(w), F.lag("end").over(w)
    twice = (F.least("end", e) - F.greatest("start", s) >= least_overlap) | (F.col("start") - s < least_gap)
    return segments.withColumn("repeats", F.coalesce(twice, F.lit(False)))


# --- upkeep


def finalize(ledger: DataFrame, done: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(task_id, status, output_path) after leaders end.  done: task_id, outcome,
    output.  Only leaders in an expected status change; their waiting followers
    take the outcome and output over."""
    ended = done.join(ledger.where(F.col("status").isin(*expected)).select("task_id"), "task_id", "left_semi")
    own = ledger.join(ended.select("task_id", F.col("outcome").alias("_o"), F.col("output").alias("_p")), "task_id", "left")
    # Only followers meet their leaders: rows without one would all be one task's, that of the null key.
    follows = F.coalesce((F.col("status") == "waiting_dependency") & F.col("leader_task_id").isNotNull(), F.lit(False))
    led = own.where(follows).join(ended.select(F.col("task_id").alias("leader_task_id"), F.col("outcome").alias("_lo"), F.col("output").alias("_lp")), "leader_task_id", "left")
    met = led.select("task_id", F.coalesce("_o", "_lo", "status").alias("status"), F.when(F.col("_lo").isNull(), F.coalesce("_p", "output_path")).otherwise(F.coalesce("_p", "_lp", "output_path")).alias("output_path"))
    return met.unionByName(own.where(~follows).select("task_id", F.coalesce("_o", "status").alias("status"), F.coalesce("_p", "output_path").alias("output_path")))


def upsert_active(items: DataFrame, updates: DataFrame, key: str, at: str, now: Column, ttl: float) -> DataFrame:
    """The newest row of each key of both, without those idle for longer than ttl."""
    rest = [c for c in items.columns if c != key]
    newest = items.unionByName(updates).groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")
    return newest.where(now - F.col(at) <= ttl)


def to_resume(tasks: DataFrame, done: DataFrame, key: str, retry_failed: bool) -> DataFrame:
    """Tasks without an end on record; failed ones too if they are to be retried."""
    ends = done.where(F.col("status").isin("completed", *([] if retry_failed else ["failed"])))
    return tasks.join(ends, key, "left_anti")


def unfinished_session(items: DataFrame, session: str, created: str, pending: Column, by: str) -> DataFrame:
    """(by, session): the newest session of each owner with a pending item."""
    return items.where(pending).groupBy(by).agg(F.max_by(session, F.struct(created, session)).alias(session))


def retained(jobs: DataFrame, owner: str, at: str, finished: Column, age: Column, ttl: float, most: int) -> DataFrame:
    """Unfinished jobs, and of the finished ones those within ttl, at most the newest `most` of each owner."""
    young = jobs.withColumn("_f", finished).where(~F.col("_f") | (age <= ttl))
    nth = F.row_number().over(Window.partitionBy(owner, "_f").orderBy(F.desc(at)))
    return young.withColumn("_k", nth).where(~F.col("_f") | (F.col("_k") <= most)).drop("_f", "_k")


def with_ids(rows: DataFrame, batch: str, order: str, pointer: str) -> DataFrame:
    """Rows of new batches with their task_id and, for a pointer to a row of the same
    batch, leader_task_id (null if there is no such row)."""
    name = lambda c: F.substring(F.sha1(F.concat_ws("|", F.col(batch).cast("string"), F.col(c).cast("string"))), 1, 16)
    known = rows.select(batch, F.col(order).alias(pointer), name(order).alias("leader_task_id"))
    named, points = rows.withColumn("task_id", name(order)), F.col(pointer).isNotNull()
    met = named.where(points).join(known, [batch, pointer], "left")
    return met.unionByName(named.where(~points).withColumn("leader_task_id", F.lit(None).cast("string")))  # rows of no pointer would all be one task's


def update_columns(table: DataFrame, changes: DataFrame, key: str, allowed: tuple[str, ...]) -> DataFrame:
    """table after changes of allowed columns; one of another column raises ValueError."""
    own = [c for c in changes.columns if c != key]
    if odd := sorted(set(own) - set(allowed)):
        raise ValueError(f"columns that can't be changed: {', '.join(odd)}")
    new = changes.select(key, F.struct(*own).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in table.columns])


def bulk_reset(ledger: DataFrame, which: Column, statuses: tuple[str, ...], to: str) -> DataFrame:
    return ledger.withColumn("status", F.when(which & F.col("status").isin(*statuses), to).otherwise(F.col("status")))


def settle_reservations(reserved: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """Reservations after their newest event: commit makes the reserved path the
    output, release frees it, others leave it."""
    last = events.groupBy(key).agg(F.max_by("action", order).alias("_a"))
    out = reserved.join(last, key, "left")
    freed = F.col("_a").isin("commit", "release")
    return out.select(key, F.when(F.col("_a") == "commit", F.col("reserved_path")).alias("output_path"), F.when(F.coalesce(freed, F.lit(False)), F.lit(None)).otherwise(F.col("reserved_path")).alias("reserved_path"))


def import_feedback(rows: DataFrame, errors: Column, manifest: DataFrame, file: str) -> DataFrame:
    """rows with their outcome: invalid where there are errors, unmatched where the
    manifest lacks the basename, else appended with the manifest's path."""
    own = manifest.groupBy(basename(F.col("path")).alias("_name")).agg(F.min("path").alias("matched_path"))
    out = rows.withColumn("_bad", F.size(errors) > 0).withColumn("_name", basename(F.col(file))).join(own, "_name", "left")
    outcome = F.when(F.col("_bad"), "invalid").when(F.col("matched_path").isNull(), "unmatched").otherwise("appended")
    return out.withColumn("outcome", outcome).drop("_bad", "_name")


def accounts(df: DataFrame, defaults: dict[str, object], enabled: str) -> DataFrame:
    """Enabled accounts (an unset flag counts as enabled), blanks filled with defaults."""
    on = F.coalesce(F.lower(F.trim(enabled)), F.lit("yes")).isin("yes", "true", "1", "")
    filled = {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(str(v))) for c, v in defaults.items()}
    return df.where(on).withColumns(filled)


def plan_items(df: DataFrame, track: str, file_order: str) -> DataFrame:
    """(track, nth, start, duration) of clip plans: order defaults to the row's
    place, start to 0, a duration is at least 0.3; an end before its start fails."""
    w = Window.partitionBy(track).orderBy(file_order)
    at = F.coalesce("start", F.lit(0.0))
    long = F.when(F.col("end") <= at, F.raise_error(F.lit("a clip ends before it starts"))).otherwise(F.greatest(F.coalesce(F.col("end") - at, F.lit(0.3)), F.lit(0.3)))
    return df.select(track, F.coalesce("order", F.row_number().over(w)).alias("nth"), at.alias("start"), long.cast("double").alias("duration"))


def with_overrides(defaults: dict[str, str], overrides: Column) -> Column:
    """A map of defaults overlaid by a row's own entries."""
    own = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)


def extended_lexicon(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(category, word): a lexicon with a user's words, trimmed; blank ones go and
    each word is in a category once."""
    rows = base.select("category", "word").unionByName(extra.select("category", "word"))
    return rows.select("category", F.btrim("word", F.lit(" \t\n\v\f\r")).alias("word")).where("word <> ''").distinct()


def pending(tasks: DataFrame, done: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """(group, key, place): tasks that are not done, each once, in order within their group."""
    left = tasks.select(group, key, order).dropDuplicates([group, key]).join(done.select(key).distinct(), key, "left_anti")
    return left.select(group, key, F.row_number().over(Window.partitionBy(group).orderBy(order, key)).alias("place"))


def error_class(message: Column, classes: dict[str, tuple[str, ...]], other: str = "other") -> Column:
    """The first class with a term that the message holds, in any case of letters."""
    low, out = F.lower(F.coalesce(message, F.lit(""))), None
    for name, terms in classes.items():
        holds = F.lit(False)
        for t in terms:
            holds = holds | F.contains(low, F.lit(t.lower()))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(other) if out is None else out.otherwise(other)


def step_summary(jobs: DataFrame, by: list[str], ok: Column, at: Column, message: Column, classes: dict[str, tuple[str, ...]]) -> DataFrame:
    """by, successes, failures, a count for each error class, and per_hour: the
    successes over the hours from the first to the last job (``at``: seconds), to
    two places; null where that is no time."""
    good = F.coalesce(ok, F.lit(False))
    kinds = jobs.select(*by, good.alias("_ok"), at.cast("double").alias("_at"), F.when(~good, error_class(message, classes)).alias("_kind"))
    span = F.max("_at") - F.min("_at")
    counts = [F.count_if(F.col("_kind") == c).alias(c) for c in [*classes, "other"]]
    return kinds.groupBy(*by).agg(F.count_if("_ok").alias("successes"), F.count_if(~F.col("_ok")).alias("failures"), *counts, F.when(span > 0, F.round(F.count_if("_ok") * 3600 / span, 2)).alias("per_hour"))


def audio_entries(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(folder, place, index, file, seconds): a folder's recordings in order.

    manifest: folder, row, index (text), file, seconds (text).  Rows without a file
    are left out; an index that is no whole number is the row's number; rows are
    ordered by index and then the file's natural name.  A folder that has no such
    row has its plain files (folder, file), numbered in natural order.
    """
    blank = lambda c: F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\v\f\r\""))
    rows = manifest.select("folder", F.coalesce(F.expr("try_cast(trim(index) AS INT)"), F.col("row")).cast("long").alias("index"), blank(F.col("file")).alias("file"), F.expr("try_cast(trim(seconds) AS DOUBLE)").alias("seconds")).where("file <> ''")
    plain = files.join(rows.select("folder").distinct(), "folder", "left_anti").select("folder", F.lit(None).cast("long").alias("index"), "file", F.lit(None).cast("double").alias("seconds"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("index", natural_key(basename(F.col("file"))), "file", "seconds"))
    every = rows.unionByName(plain).withColumn("place", place)
    return every.select("folder", "place", F.coalesce("index", F.col("place").cast("long")).alias("index"), "file", "seconds")
