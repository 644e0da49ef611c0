"""What a task or a report holds at once, or leaves on disk."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cuesmith.operators import pair_joins
from cuesmith.sources import sinks


def test_envelopes_are_dealt_to_cells_a_few_at_once(spark, monkeypatch):
    monkeypatch.setattr(pair_joins, "ROWS", 5)
    rng = random.Random(8)
    df = spark.createDataFrame([(k, [rng.random() for _ in range(16)]) for k in range(120)], "id long, v array<double>")
    few = {tuple(r) for r in pair_joins.similar_envelopes(df, "id", "v", 0.7).collect()}
    monkeypatch.setattr(pair_joins, "ROWS", 1000)
    assert few == {tuple(r) for r in pair_joins.similar_envelopes(df, "id", "v", 0.7).collect()} and few


def test_a_report_lists_all_pairs_in_little_space(spark, tmp_path):
    pairs = spark.range(5000).selectExpr("id AS left_id", "id + 1 AS right_id", "0.5D + id % 64 / 128D AS similarity", "'high' AS level")
    sinks.write_similarity_report(spark.range(10), pairs, f"file://{tmp_path}/r", 0.75)
    for name in ("pairs.json", "pairs.csv"):
        files = [f for f in (tmp_path / "r" / name).iterdir() if f.name.startswith("part-")]
        assert sum(f.stat().st_size for f in files) < 5000 * 25
    back = spark.read.csv(f"file://{tmp_path}/r/pairs.csv", header=True)
    assert back.count() == 5000 and back.agg(F.sum(F.col("left_id").cast("long"))).first()[0] == 5000 * 4999 // 2
    assert spark.read.json(f"file://{tmp_path}/r/pairs.json").count() == 5000
