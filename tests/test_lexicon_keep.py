"""Hits that are kept once, or the first only: the same as of all hits, with fewer kept."""

from __future__ import annotations

import random

import pytest

from cuesmith.operators import lexicon


@pytest.mark.parametrize("most", [8 << 20, 30])
def test_once_and_first_of_all_hits(spark, most):
    rng = random.Random(7)
    lex = spark.createDataFrame([("a", "ab", 5), ("b", "ab", 4), (None, "ba", 4), ("a", "abba", 9), ("c", "b", 1), ("c", "bbbbbbab", 2), ("c", "é", 3)], "category string, word string, ord long")
    rows = [(k, "".join(rng.choice("aabbé ") for _ in range(rng.choice([0, 1, 5, 40])))) for k in range(400)] + [(900, None), (901, "xbbbbbbab"), (902, "ab" * 20000)]
    df = spark.createDataFrame(rows, "id long, text string")
    hits = lambda keep: {r["id"]: [tuple(h) for h in r["hits"]] for r in lexicon.with_hits(df, "text", lex, most_bytes=most, keep=keep).collect()}
    every, once, first = hits("all"), hits("once"), hits("first")
    for k, own in every.items():
        least = {}
        for h in own:
            least.setdefault(h[1:], h)
        assert set(once[k]) == set(least.values()) and len(once[k]) == len(least) and first[k] == own[:1]
    assert first[901][0][:2] == (1, 1) or first[901][0][0] == 1
    assert len(every[902]) > 50000 and len(once[902]) < 8
