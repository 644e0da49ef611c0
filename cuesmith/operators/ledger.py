"""Job-ledger operators: listing, paging, leaders and followers, maintenance.

A ledger is a DataFrame with one row for each task.  Writes are expressed as
projections that give the ledger's next version; whoever stores it commits that
version (one writer at a time: concurrent claims need a transactional store).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ledger's statuses.
STATUSES = ("pending", "validating", "tts_running", "tts_done", "video_running", "retry_wait", "completed", "failed", "cancelled", "interrupted", "waiting_dependency", "output_committed", "cancelling")
TERMINAL = ("completed", "failed", "cancelled")
RUNNING = ("validating", "tts_running", "tts_done", "video_running")
#: What a follower takes over from its leader.
COPIED = ("output_path", "video_duration", "tts_duration", "concat_duration", "final_duration", "encoder_used", "hw_fallback_used")


def domain(df: DataFrame, values: tuple[str, ...], name: str) -> DataFrame:
    """A one-column table of a fixed domain, in the domain's order."""
    return df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, values))).alias("ord", name))


def list_tasks(ledger: DataFrame, batch_id=None, status=None, excel_row=None, text=None, order: str = "row", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Optional filters, all of which must hold; text is looked for in three
    columns without regard to case, and its % and _ are wildcards."""
    df = ledger
    for name, value in (("batch_id", batch_id), ("status", status), ("excel_row", excel_row)):
        if value is not None:
            df = df.where(F.col(name) == value)
    if text:
        like = f"%{text}%"
        df = df.where(F.col("input_video").ilike(like) | F.col("text").ilike(like) | F.col("task_id").cast("string").ilike(like))
    keys = {"row": [F.asc("batch_id"), F.asc("excel_row")], "updated": [F.desc("updated_at"), F.desc("task_id")], "id": [F.asc("task_id")]}[order]
    df = df.orderBy(*keys)
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df


def is_safe_id(value: Column) -> Column:
    """Six to 32 lower-case hex digits, and nothing else."""
    return F.coalesce(value.rlike(r"\A[a-f0-9]{6,32}\z"), F.lit(False))


def count_by_status(ledger: DataFrame) -> DataFrame:
    """(status, n) over all statuses, zero where there is none."""
    counts = ledger.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(domain(ledger, STATUSES, "status")).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def batch_status_counts(ledger: DataFrame, batches: DataFrame, newest: int = 50) -> DataFrame:
    """The newest batches with a count for each status and a total."""
    top = batches.orderBy(F.desc("created_at"), F.asc("batch_id")).limit(newest)
    picked = ledger.join(top, "batch_id", "left_semi").groupBy("batch_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES])
    return top.join(picked, "batch_id", "left").select("batch_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", *[f"n_{s}" for s in STATUSES])])


def batch_summary(ledger: DataFrame, alive: int = 2) -> DataFrame:
    """Counts of each batch, and seconds left: the slower of the two queues' work."""
    waits = F.col("status").isin("pending", "retry_wait")
    to_render = F.col("status").isin("tts_done")
    mean = lambda c: F.avg(F.when((F.col("status") == "completed") & (F.col(c) > 0), F.col(c)))
    sums = ledger.groupBy("batch_id").agg(
        F.count("*").alias("total"), F.count_if(waits).alias("pending"), F.count_if(to_render).alias("to_render"), F.count_if(F.col("status") == "completed").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(mean("tts_duration"), F.lit(0.0)).alias("avg_tts"), F.coalesce(mean("video_duration"), F.lit(0.0)).alias("avg_video"),
    )
    eta = F.greatest(F.col("pending") * F.col("avg_tts") / alive, (F.col("pending") + F.col("to_render")) * F.col("avg_video") / alive)
    return sums.select("batch_id", "total", "pending", "to_render", "done", "failed", eta.alias("eta_seconds"))


def changed_since(ledger: DataFrame, updated_at: float, task_id, limit: int) -> DataFrame:
    """One keyset page after the cursor, with the page's has_more and each row's
    own cursor.  One row more than the page is read to know has_more."""
    after = (F.col("updated_at") > updated_at) | ((F.col("updated_at") == updated_at) & (F.col("task_id") > task_id))
    page = ledger.where(after).orderBy("updated_at", "task_id").limit(limit + 1)
    nth = F.row_number().over(Window.orderBy("updated_at", "task_id"))  # over limit + 1 rows
    more = F.count("*").over(Window.partitionBy(F.lit(1))) > limit
    return page.withColumns({"nth": nth, "has_more": more}).where(F.col("nth") <= limit).withColumn("cursor", F.concat_ws("|", F.format_string("%.9f", "updated_at"), F.col("task_id").cast("string"))).drop("nth")


def next_claim(ledger: DataFrame, statuses: tuple[str, ...], now: float, paused: DataFrame | None = None) -> DataFrame:
    """The row that a worker would take next: due, of a batch that isn't paused,
    oldest first.  A query only; taking it is the store's compare-and-set."""
    df = ledger.where(F.col("status").isin(*statuses) & (F.col("next_attempt_at") <= now))
    if paused is not None:
        df = df.join(paused.select("batch_id"), "batch_id", "left_anti")
    return df.orderBy("created_at", "excel_row", "task_id").limit(1)


def newest_by_fingerprint(ledger: DataFrame, status: str = "completed", wanted: DataFrame | None = None) -> DataFrame:
    """(fingerprint, task_id, finished_at): the newest task of each fingerprint,
    of those in wanted if given; the larger id where times are equal."""
    df = ledger.where(F.col("status") == status)
    if wanted is not None:
        df = df.join(wanted.select("fingerprint"), "fingerprint", "left_semi")
    at = F.when(F.col("finished_at") > 0, F.col("finished_at")).otherwise(F.col("updated_at"))
    return df.groupBy("fingerprint").agg(F.max(F.struct(at.alias("at"), "task_id")).alias("m")).select("fingerprint", F.col("m.task_id").alias("task_id"), F.col("m.at").alias("finished_at"))


def plan_batch(rows: DataFrame, completed: DataFrame) -> DataFrame:
    """Each row's part in a new batch: invalid, reused (a completed task has its
    fingerprint), leader (first row of its fingerprint) or follower, with the
    row or task that it points to.

    The first row of a fingerprint comes from an aggregate and a join rather than
    a window, so a fingerprint that a third of all rows share is not one task's.
    """
    valid = rows.where("valid")
    first = valid.groupBy("batch_id", "fingerprint").agg(F.min("excel_row").alias("leader_row"))
    hits = completed.select("fingerprint", F.col("task_id").alias("reused_task"))
    joined = rows.join(first, ["batch_id", "fingerprint"], "left").join(hits, "fingerprint", "left")
    role = F.when(~F.col("valid"), "invalid").when(F.col("reused_task").isNotNull(), "reused").when(F.col("excel_row") == F.col("leader_row"), "leader").otherwise("follower")
    return joined.withColumn("role", role).select("batch_id", "excel_row", "fingerprint", "role", F.when(F.col("role") == "follower", F.col("leader_row")).alias("leader_row"), F.when(F.col("role") == "reused", F.col("reused_task")).alias("reused_task"))


def _with_leader(ledger: DataFrame) -> DataFrame:
    """Waiting followers with their leaders' columns as l_*."""
    leader = ledger.select(F.col("task_id").alias("l_task_id"), F.col("batch_id").alias("l_batch_id"), F.col("status").alias("l_status"), *[F.col(c).alias(f"l_{c}") for c in COPIED if c in ledger.columns])
    waits = ledger.where(F.col("status") == "waiting_dependency")
    return waits.join(leader, waits.leader_task_id == leader.l_task_id, "left")


def reconcile(ledger: DataFrame) -> DataFrame:
    """Waiting followers after their leaders' end: the leader's outcome, or failed
    as an orphan where it is missing or of another batch (tested first), or still
    waiting.  Completed followers take over the leader's output."""
    f = _with_leader(ledger)
    orphan = F.col("l_status").isNull() | (F.col("l_batch_id") != F.col("batch_id"))
    status = F.when(orphan, "failed").when(F.col("l_status").isin(*TERMINAL), F.col("l_status")).otherwise(F.col("status"))
    error = F.when(orphan, "orphan_dependency").when(F.col("l_status") == "failed", "leader_terminated").when(F.col("l_status") == "cancelled", "cancelled").otherwise("")
    done = ~orphan & (F.col("l_status") == "completed")
    copied = [F.when(done, F.col(f"l_{c}")).otherwise(F.col(c)).alias(c) for c in COPIED if c in ledger.columns]
    return f.select("task_id", "batch_id", status.alias("new_status"), error.alias("error_type"), *copied)


def reconcile_stats(ledger: DataFrame) -> DataFrame:
    r = reconcile(ledger)
    orphan = F.col("error_type") == "orphan_dependency"
    return r.agg(
        F.count_if(F.col("new_status") == "completed").alias("follower_completed"), F.count_if((F.col("new_status") == "failed") & ~orphan).alias("follower_failed"),
        F.count_if(F.col("new_status") == "cancelled").alias("follower_cancelled"), F.count_if(orphan).alias("follower_orphan_failed"),
    )


def followers(ledger: DataFrame, leaders: DataFrame) -> DataFrame:
    return ledger.join(leaders.select(F.col("task_id").alias("leader_task_id")), "leader_task_id", "left_semi")


def cancel(ledger: DataFrame) -> DataFrame:
    """(task_id, old_status, new_status) of those that a cancel changes: waiting
    work ends at once, running work is asked to stop, ended work stays."""
    new = F.when(F.col("status").isin("pending", "retry_wait", "waiting_dependency", "interrupted"), "cancelled").when(F.col("status").isin(*RUNNING), "cancelling")
    return ledger.select("task_id", F.col("status").alias("old_status"), new.alias("new_status")).where("new_status is not null")


def advance(ledger: DataFrame, moves: DataFrame) -> DataFrame:
    """The ledger after compare-and-set moves (task_id, from_status, to_status): a
    move counts only if the task still has from_status and is not ended; of
    several for one task, the first by seq."""
    ok = ledger.join(moves, "task_id").where((F.col("status") == F.col("from_status")) & ~F.col("status").isin(*TERMINAL))
    first = ok.groupBy("task_id").agg(F.min_by("to_status", "seq").alias("to_status"))
    return ledger.join(first, "task_id", "left").withColumn("status", F.coalesce("to_status", "status")).drop("to_status")


def retry_failed(ledger: DataFrame, only_retryable: bool = True) -> DataFrame:
    """(task_id, new_status) of failed tasks that may run again: followers wait
    again, others are pending; invalid rows and, if asked, client errors stay."""
    skip = ["excel_invalid"] + ["client_error", "video_error"] * only_retryable
    failed = ledger.where((F.col("status") == "failed") & ~F.coalesce(F.col("error_type"), F.lit("")).isin(*skip))
    return failed.select("task_id", F.when(F.col("leader_task_id").isNotNull(), "waiting_dependency").otherwise("pending").alias("new_status"))


def route_http_error(status_code: Column, attempts: Column, now: Column, base: float = 1.0, cap: float = 30.0, most: int = 5) -> tuple[Column, Column, Column]:
    """(class, new status, next attempt) of a failed request: client errors but 429
    fail; others wait with doubling delays, up to `most` attempts."""
    kind = F.when(status_code == 429, "retryable_429").when(status_code.between(500, 599), "retryable_5xx").when(status_code.between(400, 499), "client_4xx").otherwise("other")
    fails = (kind == "client_4xx") | (attempts >= most)
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    return kind, F.when(fails, "failed").otherwise("retry_wait"), F.when(fails, F.lit(0.0)).otherwise(now + delay)


def reserve_paths(tasks: DataFrame) -> DataFrame:
    """(task_id, path): the base path, then _2, _3 and so on before the extension."""
    nth = F.row_number().over(Window.partitionBy("base_path").orderBy("task_id"))
    stem, ext = F.regexp_extract("base_path", r"\A(.*?)(\.[^./]*)?\z", 1), F.regexp_extract("base_path", r"\A.*?(\.[^./]*)?\z", 1)
    return tasks.withColumn("nth", nth).select("task_id", F.when(F.col("nth") == 1, F.col("base_path")).otherwise(F.concat(stem, F.lit("_"), F.col("nth").cast("string"), ext)).alias("path"))


def recover(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(task_id, old_status, new_status) after a restart: committed output ends a
    task, kept speech resumes it at rendering, other running work starts anew,
    and a stop that was asked for is done."""
    have = artifacts.groupBy("task_id").agg(F.max("has_output").alias("has_output"), F.max("has_speech").alias("has_speech"))
    df = ledger.where(F.col("status").isin(*RUNNING, "output_committed", "cancelling")).join(have, "task_id", "left")
    out, speech = F.coalesce("has_output", F.lit(False)), F.coalesce("has_speech", F.lit(False))
    new = F.when(F.col("status") == "cancelling", "cancelled").when(F.col("status").isin("output_committed", "video_running") & out, "completed").when(F.col("status").isin("tts_done", "video_running", "output_committed") & speech, "tts_done").otherwise("pending")
    return df.select("task_id", F.col("status").alias("old_status"), new.alias("new_status"))


def export_rows(ledger: DataFrame) -> DataFrame:
    """Display columns: long texts shortened, unset times empty, seconds with three digits."""
    text = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 56), F.lit("…"))).otherwise(F.col("text"))
    when = F.when(F.col("finished_at") > 0, F.date_format(F.timestamp_seconds("finished_at"), "yyyy-MM-dd HH:mm:ss")).otherwise("")
    return ledger.select("task_id", "batch_id", "status", text.alias("text"), when.alias("finished"), F.format_string("%.3f", "video_duration").alias("video_seconds"))
