"""Importance resampling against a plain version, long texts and odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import pytest

from cuesmith.llm import resampling

from ..compare import SF_DIR, differences

KIND = "doc_id long, text string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def features(text, order):
    w = re.findall(resampling.WORD, lowered(text))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, order=1):
    of = lambda text: collections.Counter(zlib.crc32(g.encode()) % 10000 for g in features(text, order)[1])
    raw, want = collections.Counter(), collections.Counter()
    for _, text in docs:
        raw += of(text)
    for _, text in target:
        want += of(text)
    s, t = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in raw}
    rows = []
    for i, text in docs:
        own = of(text)
        n = sum(own.values())
        weight = sum(gain[b] * c for b, c in own.items()) // n if n else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, features(text, 1)[0]])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return sorted(tuple(r[:5]) for r in rows)


def test_against_a_plain_version(spark):
    docs, target = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = [tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in target.select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in resampling.resample(docs, target).collect())
    assert got == plain(a, b)
    assert sum(r[4] is not None for r in got) == 10 * sum(features(t, 1)[0] >= 20 for _, t in a) // 100


def test_against_sql(spark):
    from cuesmith.llm import entries

    assert differences(spark, SF_DIR, entries.op12_importance_resampling, entries.OP12_SQL) == ""


@pytest.mark.parametrize("order", [1, 3])
def test_long_texts_in_stretches(spark, order, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 40)
    text = "Alpha beta gamma, DELTA\x00" + "ÄÖ9 überaus " * 7 + "x" * 130 + " one two; three\nfour " + "y" * 90 + "é" * 50
    found = []
    for table in resampling._tables(__import__("pyarrow").array([text, None, "a b"]), order):
        con = resampling._session()
        con.register("slice", table)
        found += con.sql(resampling._counts_sql(order)).fetchall()
    for row, t in enumerate([text, None, "a b"]):
        got, n = collections.Counter(), 0
        for _, words, b, c in (r for r in found if r[0] == row):
            n += words
            got.update(dict(zip(b or [], c or [], strict=True)))
        want = features(t, order)
        assert n == want[0] and got == collections.Counter(zlib.crc32(g.encode()) % 10000 for g in want[1])


def test_longer_ngrams_and_equal_scores(spark):
    docs = [(i % 40, "the same words again and again in a text that is long enough to be drawn by its score so here we go") for i in range(80)] + [(100 + i, "short one") for i in range(5)]
    target = [(1, "the same words again")]
    got = sorted((tuple(r) for r in resampling.resample(spark.createDataFrame(docs, KIND), spark.createDataFrame(target, "item_id long, text string"), order=2).collect()), key=repr)
    want = plain(docs, target, 2)
    assert [r[:4] for r in sorted(got, key=repr)] == [r[:4] for r in sorted(want, key=repr)]
    ranks = sorted(r[4] for r in got if r[4])
    assert ranks == list(range(1, 9)) and sorted(r[0] for r in got if r[4]) == sorted(r[0] for r in want if r[4])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "!!! ... \n"), (4, "w " * 200_000), (4, "w " * 200_000), (5, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, 1, 2, None) for r in rows], KIND + ", n_words int, buckets int, id string")
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    out = resampling.resample(docs, target).collect()
    assert len(out) == 7 and {(r["doc_id"], r["n_features"]) for r in out} == {(1, 0), (2, 0), (None, 3), (3, 0), (4, 200_000), (5, 1)}
    assert all(r["weight"] == 0 for r in out if r["n_features"] == 0) and all(r["rank"] is None for r in out)
    none = spark.createDataFrame([], KIND)
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(docs, spark.createDataFrame([], "item_id long, text string")).count() == 7
