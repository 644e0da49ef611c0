"""A ledger's change feed as a streaming source, and expiry by keyed state.

The feed's offset is a cursor (updated_at, task_id), as in the paged form
``ledger.changed_since``: rows of one timestamp are told apart by their ids, so a
batch that ends between them loses none, and a restarted query goes on from the
cursor that it has checkpointed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Before the first change.
START = {"at": "null", "id": "null"}


class Changes(InputPartition):
    def __init__(self, path: str, start: dict, end: dict):
        self.path, self.start, self.end = path, start, end


class ChangeFeed(DataSource):
    """Options: path (a folder of Parquet files, to which changes are appended), at and
    id (the cursor's columns; updated_at and task_id)."""

    @classmethod
    def name(cls) -> str:
        return "ledger_changes"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ChangeReader(self.options, schema.fieldNames())


class _ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.at, self.id, self.columns = options["path"], options.get("at", "updated_at"), options.get("id", "task_id"), columns

    def _files(self) -> list[str]:
        return sorted(pads.dataset(self.path, format="parquet").files)

    def initialOffset(self) -> dict:
        return dict(START)

    def latestOffset(self) -> dict:
        best = None
        for batch in pads.dataset(self.path, format="parquet").to_batches(columns=[self.at, self.id]):
            batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
            if batch.num_rows:
                top = pc.max(batch.column(0))
                own = (top.as_py(), pc.max(batch.column(1).filter(pc.equal(batch.column(0), top))).as_py())
                best = own if best is None else max(best, own)
        return dict(START) if best is None else {"at": json.dumps(best[0]), "id": json.dumps(best[1])}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        return [Changes(f, start, end) for f in self._files()] if start != end else []

    def read(self, partition: Changes) -> Iterator[pa.RecordBatch]:
        at, key = pads.field(self.at), pads.field(self.id)
        after, upto = [(json.loads(o["at"]), json.loads(o["id"])) for o in (partition.start, partition.end)]
        wanted = (at < upto[0]) | ((at == upto[0]) & (key <= upto[1]))
        if after[0] is not None:
            wanted = wanted & ((at > after[0]) | ((at == after[0]) & (key > after[1])))
        for batch in pads.dataset(partition.path, format="parquet").to_batches(columns=self.columns, filter=wanted):
            if batch.num_rows:
                yield batch


def change_feed(spark: SparkSession, path: str, schema: StructType | str, at: str = "updated_at", key: str = "task_id") -> DataFrame:
    """The changes of the Parquet files at path as a stream, each once.  A change that is
    written later but stands before the cursor is not seen, as in the paged form; nor
    is one without a timestamp or id."""
    spark.dataSource.register(ChangeFeed)
    return spark.readStream.format("ledger_changes").schema(schema).option("path", path).option("at", at).option("id", key).load()


class _Active(StatefulProcessor):
    """A key's last activity, and a timer for when it will have been idle too long."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [part["at"].to_numpy().astype("datetime64[ms]").astype("int64") for part in rows]
        times = np.unique(np.concatenate(parts)).astype(float).tolist() if parts else []
        was = last = self.last.get()[0] if self.last.exists() else None
        told: list[tuple[float, str]] = []
        for t in times:
            if last is None or t - last > self.ttl_ms:  # idle too long between rows of one batch, before its timer could tell
                told += [(last, "expired")] * (last is not None) + [(t, "active")]
            last = t if last is None else max(last, t)
        if last != was:
            if was is not None:
                self.handle.deleteTimer(int(was) + self.ttl_ms)
            self.last.update((last,))
            self.handle.registerTimer(int(last) + self.ttl_ms)
        if told:
            yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield self._rows(key, [(last, "expired")])

    def close(self) -> None:
        pass

    def _rows(self, key, told: list[tuple[float, str]]) -> pd.DataFrame:
        return pd.DataFrame({"id": [str(key[0])] * len(told), "last_active": [t / 1000 for t, _ in told], "event": [event for _, event in told]})


def expiries(items: DataFrame, key: str, at: str, ttl: float = 12 * 3600.0, late: str = "1 minute") -> DataFrame:
    """(id, last_active, event) of a stream of (key, at): a row when a key becomes
    active, and one when the watermark is ``ttl`` seconds past its last activity; the
    key's state goes then.  Once for each idle spell; activity that comes after later
    activity of its key adds nothing.  Needs the RocksDB state store."""
    rows = items.select(F.col(key).cast("string").alias("id"), F.col(at).alias("at")).where("id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    schema = StructType([StructField("id", StringType()), StructField("last_active", DoubleType()), StructField("event", StringType())])
    return rows.groupBy("id").transformWithStateInPandas(_Active(int(ttl * 1000)), schema, "append", "eventTime")


def expired_in_batch(items: DataFrame, key: str, at: str, watermark: float, ttl: float = 12 * 3600.0) -> DataFrame:
    """The expired rows that ``expiries`` gives when its watermark stands at so many
    seconds: every gap of ttl or more in a key's activity, the one that is open too."""
    from pyspark.sql import Window

    own = items.select(F.col(key).cast("string").alias("id"), F.col(at).cast("double").alias("s")).where("id IS NOT NULL AND s IS NOT NULL")
    after = F.coalesce(F.lead("s").over(Window.partitionBy("id").orderBy("s")), F.lit(float("inf")))
    return own.withColumn("n", after).where((F.col("n") - F.col("s") > ttl) & (F.col("s") + ttl <= watermark)).select("id", F.col("s").alias("last_active"), F.lit("expired").alias("event")).distinct()
