"""Streaming twins of the ledger's feeds: latest state, expiry, breaker.

Each has a batch form over the same rows that gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Breaker


def latest_state(changes: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's newest row; on a stream, in update or complete mode."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def upsert_into(path: str, key: str, order: str):
    """A foreachBatch writer that merges each micro-batch's newest rows into the
    versioned Parquet table at path: version n holds the state after batch n, so a
    batch that runs twice writes the same version again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = latest_state(batch, key, order)
        if batch_id > 0:
            new = latest_state(spark.read.schema(batch.schema).parquet(f"{path}/version={batch_id - 1}").unionByName(new.select(*batch.columns)), key, order)
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return write


def expire(items: DataFrame, now: float, ttl: float = 12 * 3600.0) -> DataFrame:
    """Items active within ttl seconds of now, newest first."""
    return items.where(F.col("last_active") >= now - ttl).orderBy(F.desc("last_active"), "id")


def recent_counts(events: DataFrame, at: str, by: str, window: str, slide: str, late: str) -> DataFrame:
    """Event counts in sliding windows; rows later than `late` behind are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, window, slide), by).agg(F.count("*").alias("n"))


def breaker_states(events: DataFrame, key: str, idle: str = "1 hour", **settings) -> DataFrame:
    """(key, seq, allowed, state) of a stream of (key, seq, at, kind, retry_after):
    a key's breaker is its state, dropped when idle.  A stream that is to end by
    itself (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off,
    for batches without data go on as long as a key may yet time out."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        breaker, rows = Breaker(**settings, state=state.get if state.exists else None), []
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            allowed = breaker.on(e.kind, e.at, None if pd.isna(e.retry_after) else e.retry_after)
            rows.append((k[0], e.seq, allowed, breaker.state))
        state.update(breaker.values())
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=[key, "seq", "allowed", "state"]).astype({"allowed": "boolean"})

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return events.select(key, "seq", "at", "kind", "retry_after").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, seq long, allowed boolean, state string", "state string, failed int, until double, probe double", "append", GroupStateTimeout.ProcessingTimeTimeout)
