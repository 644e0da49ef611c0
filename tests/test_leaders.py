"""Rows without a leader are spread over tasks where followers meet their leaders."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import records


@pytest.fixture
def plain(spark):
    """Joins by shuffle, partitions as they are dealt."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_finalize_spreads_rows_without_a_leader(plain):
    led = plain.range(4000).selectExpr("id AS task_id", "CASE WHEN id % 10 = 3 THEN 'waiting_dependency' WHEN id % 10 = 2 THEN 'tts_done' ELSE 'pending' END AS status", "CASE WHEN id % 10 = 3 AND id % 20 <> 3 THEN id - 1 END AS leader_task_id", "concat('o', id) AS output_path")
    done = plain.range(4000).selectExpr("id AS task_id", "CASE WHEN id % 3 > 0 THEN 'completed' END AS outcome", "concat('d', id) AS output").where("task_id % 5 > 0")
    out = records.finalize(led, done, ("tts_done",))
    assert most_in_a_task(out) < 2000
    got = {r["task_id"]: (r["status"], r["output_path"]) for r in out.collect()}
    assert len(got) == 4000 and got[0] == ("pending", "o0") and got[2] == ("completed", "d2")
    assert got[13] == ("waiting_dependency", "o13") and got[33] == ("completed", "d32") and got[3] == ("waiting_dependency", "o3")
    assert got[12] == ("tts_done", "d12")  # an outcome of null changes no status
    assert got[53] == ("completed", "d52")


def test_ids_spread_rows_without_a_pointer(plain):
    rows = plain.range(4000).selectExpr("'b' AS batch", "id AS n", "CASE WHEN id % 4 = 1 THEN id - 1 END AS leads")
    out = records.with_ids(rows, "batch", "n", "leads")
    assert most_in_a_task(out) < 2000
    got = {r["n"]: (r["task_id"], r["leader_task_id"]) for r in out.collect()}
    assert len(got) == 4000 and got[1][1] == got[0][0] and got[2][1] is None
