"""Exact medians by narrowing against sorting."""

from __future__ import annotations

import math
import random
import statistics

import pytest

from cuesmith.operators.feedback import calibration, number_stats
from cuesmith.operators.medians import exact_medians


def shapes():
    rng = random.Random(1)
    yield "even", [float(k) for k in range(1000)]
    yield "odd", [float(k * k) for k in range(999)]
    yield "tail", [math.exp(rng.gauss(0, 20)) for _ in range(900)]
    yield "two values", [1.0] * 500 + [2.0] * 500
    yield "mass", [5.0] * 700 + [rng.random() * 10 for _ in range(300)]
    yield "mass beside", [1.0] * 450 + [rng.random() + 1 for _ in range(100)] + [3.0] * 450
    yield "gap", [-1e300] * 400 + [0.0] * 100 + [1e-300] * 500
    yield "one", [3.5]
    yield None, [rng.choice([-0.0, 0.0, 7.0]) for _ in range(301)]


@pytest.mark.parametrize("limit", [1, 20, 100_000])
def test_against_sorting(spark, limit):
    groups = list(shapes())
    rows = [(g, v) for g, vs in groups for v in [*vs, None]] + [("nulls", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r["g"]: (r["n"], r["least"], r["middle"], r["most"]) for r in exact_medians(df, ["g"], "v", limit).collect()}
    assert got == {g: (len(vs), min(vs), statistics.median(vs), max(vs)) for g, vs in groups}


def test_stats_and_calibration(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 4), (None, 9)], "g string, v int")
    assert {tuple(r) for r in number_stats(df, ["g"], "v").collect()} == {("a", 2, 1, 1.5, 2), ("b", 0, None, None, None), (None, 2, 4, 6.5, 9)}
    rows = spark.createDataFrame([(k % 3 == 0, float(k)) for k in range(15)] + [(None, 100.0)], "d boolean, v double")
    assert tuple(calibration(rows, rows["d"], "v").first()) == (5, 11, True, 6.0, 8.0)
    assert tuple(calibration(rows.limit(0), rows["d"], "v").first()) == (0, 0, False, None, None)
    assert exact_medians(rows.limit(0), [], "v").count() == 0


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert exact_medians(df, [], "v").first()["middle"] == 2.0
