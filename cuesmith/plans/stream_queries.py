"""Streams over files made from the driver's tables, run until nothing is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import fresh_folder
from ..streaming import changes
from .registry import query, table

_LEDGER = "task_id long, updated_at double, status string"


def _drained(stream, mode: str = "append"):
    spark = stream.sparkSession
    out = fresh_folder(spark)
    q = stream.writeStream.format("parquet").option("checkpointLocation", fresh_folder(spark)).outputMode(mode).start(out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out)


@query("m01_change_feed", "SELECT event_id AS task_id, CAST(epoch_us(ts) // 86400000000 AS DOUBLE) AS updated_at, event_type AS status FROM events")
def change_feed(spark, sf_dir):
    """A ledger of whole days, so that very many changes have one timestamp, read as a stream."""
    at = fresh_folder(spark)
    table(spark, sf_dir, "events").selectExpr("event_id AS task_id", "CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts) div 86400000000 AS DOUBLE) AS updated_at", "event_type AS status").write.parquet(at)
    return _drained(changes.change_feed(spark, at, _LEDGER))


@query("m11_expiries", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS ms, lead(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS n, max(epoch_us(ts) // 1000) OVER () - 60000 AS mark FROM events)
SELECT DISTINCT id, ms / 1000 AS last_active, 'expired' AS event FROM e WHERE coalesce(n - ms > 43200000, ms + 43200000 <= mark)""")
def expiries(spark, sf_dir):
    """Users idle for more than twelve hours, told by the state's timers."""
    at, key = fresh_folder(spark), "spark.sql.streaming.stateStore.providerClass"
    table(spark, sf_dir, "events").select("user_id", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts))").alias("at")).write.parquet(at)
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("user_id long, at timestamp").parquet(at)
        return _drained(changes.expiries(stream, "user_id", "at")).where("event = 'expired'")
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
