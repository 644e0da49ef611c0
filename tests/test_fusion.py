"""Weighing and the greedy choice in rounds against one loop over all candidates."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuesmith.operators import fusion

KIND = "track long, source string, start double, duration double, text string"


def made(seed, n, dense):
    rng = random.Random(seed)
    return [[(rng.choice([1, 1, 1, 2]), rng.choice("ab"), rng.randrange(n * dense) * 0.25, rng.randint(0, 24) * 0.25, rng.choice(["", "hit!", "cry?", None])) for _ in range(n)] for _ in range(4)]


def overlap(a, b):
    return min(a[2] + a[3], b[2] + b[3]) - max(a[2], b[2]) if a[:2] == b[:2] else -1


def weighed(groups, clip):
    out = []
    for k, rows in enumerate(groups):
        for r in rows:
            score = (105, 78, 50, 42)[k] + min(35, 7 * ("hit" in (r[4] or "")) + 4 * any(m in (r[4] or "") for m in "?!"))
            score += sum(b for j, b in enumerate((28, 18, 8, 6)) if j != k and any(overlap(r, o) >= 0.25 for o in groups[j]))
            out.append((*r[:4], r[4] or "", k, score + max(0.0, 5 - abs(r[3] - clip))))
    return out


def chosen(rows, target, gap):
    taken, total = {}, {}
    for r in sorted(rows, key=lambda r: (-r[6], r[5], r[1], r[2], r[3], r[4])):
        own = taken.setdefault(r[0], [])
        left = target - total.get(r[0], 0.0)
        if left <= 0 or any(o[1] == r[1] and (overlap(r, o) >= 0.25 or abs(o[2] - r[2]) < gap) for o in own) or min(r[3], left) < 0.35:
            continue
        own.append((*r[:3], min(r[3], left), *r[4:]))
        total[r[0]] = total.get(r[0], 0.0) + min(r[3], left)
    return sorted((r[0], n, r[1], r[2], r[3], r[5], r[6], r[4]) for own in taken.values() for n, r in enumerate(sorted(own, key=lambda r: (r[1], r[2])), 1))


@pytest.mark.parametrize("dense, rounds", [(1, 24), (4, 24), (2, 1)])
def test_against_one_loop(spark, dense, rounds, monkeypatch):
    monkeypatch.setattr(fusion, "ROUNDS", rounds)
    monkeypatch.setattr(fusion.without_near, "__defaults__", (rounds, None))
    groups = made(dense, 30, dense)
    kinds = [fusion.Kind(str(k), b, o, spark.createDataFrame(g, KIND)) for k, (b, o, g) in enumerate(zip((105, 78, 50, 42), (28, 18, 8, 6), groups, strict=True))]
    rows = fusion.weigh(kinds, 4.0, ("hit",), span=7.0)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(weighed(groups, 4.0))
    got = sorted(tuple(r) for r in fusion.fuse(rows, 25.0, 3.0).collect())
    assert got == chosen(weighed(groups, 4.0), 25.0, 3.0) and len(got) > 6


def test_a_rising_score_is_settled_in_turn(spark):
    rows = spark.createDataFrame([(1, "a", k * 0.5, 2.0, "", 0, float(k)) for k in range(200)], "track long, source string, start double, duration double, text string, kind int, score double")
    got = [r["start"] for r in fusion.without_near(rows, ["track", "source"], [-F.col("score")], 1.0, rounds=2).collect()]
    assert sorted(got) == [99.5 - 2.0 * k for k in range(50)][::-1]


def test_odd_candidates(spark):
    rows = [(None, "a", 0.0, 5.0, "x"), (1, None, 0.0, 5.0, "x"), (1, "a", 0.0, 0.1, "x"), (1, "a", -2.0, 3.0, None), (1, "a", -2.0, 3.0, None)]
    kinds = [fusion.Kind("one", 1.0, 1.0, spark.createDataFrame(rows, KIND)), fusion.Kind("none", 1.0, 1.0, spark.createDataFrame([], KIND))]
    out = fusion.fuse(fusion.weigh(kinds, 3.0), 60.0, 1.0).collect()
    assert [(r["track"], r["nth"], r["source"], r["start"], r["duration"]) for r in out] == [(1, 1, "a", 0.0, 3.0)]
