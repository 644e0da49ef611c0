"""The change feed over restarts, and expiry by state like its batch form."""

from __future__ import annotations

import pandas as pd

from cuesmith.streaming import changes

SCHEMA = "task_id string, updated_at double, status string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drained(spark, folder, out, cp):
    q = changes.change_feed(spark, folder, SCHEMA).writeStream.format("parquet").option("checkpointLocation", cp).start(out)
    q.processAllAvailable()
    q.stop()
    return sorted(r["task_id"] for r in spark.read.schema(SCHEMA).parquet(out).collect())


def test_equal_timestamps_by_pages_and_restarts(spark, tmp_path):
    folder, out, cp = (f"{tmp_path}/{n}" for n in ("ledger", "out", "cp"))
    ids = [f"t{k:05d}" for k in range(2000)]
    for page in range(5):
        put(spark, folder, [(i, 100.0, "queued") for i in ids[page * 200 : page * 200 + 200]])
    assert drained(spark, folder, out, cp) == ids[:1000]
    assert drained(spark, folder, out, cp) == ids[:1000]
    for page in range(5, 10):
        put(spark, folder, [(i, 100.0, "queued") for i in ids[page * 200 : page * 200 + 200]])
    put(spark, folder, [("t00000", 101.5, "done"), (None, 102.0, "odd"), ("x", None, "odd")])
    assert drained(spark, folder, out, cp) == sorted([*ids, "t00000"])


def test_expiry_like_batch_and_state_shrinks(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    hours = {0: [("a", 0), ("b", 0), ("c", 1)], 1: [("a", 5), ("d", 6)], 2: [("b", 20), ("c", 21)], 3: [("z", 60)], 4: [("z", 61)]}
    for n, rows in hours.items():
        spark.createDataFrame([(k, (start + pd.Timedelta(hours=h)).to_pydatetime()) for k, h in rows], "k string, at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n={n}")
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("k string, at timestamp, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = changes.expiries(stream, "k", "at", 12 * 3600.0).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start(f"{tmp_path}/out")
        q.processAllAvailable()
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        q.stop()
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = spark.read.parquet(f"{tmp_path}/out")
    every = spark.read.parquet(f"{tmp_path}/in")
    mark = (start + pd.Timedelta(hours=61) - pd.Timedelta(minutes=1)).timestamp()
    want = sorted(map(tuple, changes.expired_in_batch(every, "k", "at", mark).collect()))
    assert sorted(map(tuple, got.where("event = 'expired'").collect())) == want and {r[0] for r in want} == {"a", "b", "c", "d"}
    assert rows[-1] < max(rows)
