"""MinHash near duplicates against brute force, on families of copies and odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from cuesmith.llm import minhash

from ..compare import SF_DIR

KIND = "doc_id long, text string"


def sets_of(docs, width=3):
    out = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def brute(docs, percent=85):
    sets = sets_of(docs)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y) and find(a) != find(b):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def found(spark, docs, **more):
    out = minhash.minhash_components(spark.createDataFrame(docs, KIND), **more).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}


def test_given_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, docs) == brute(docs)


def test_families_whose_copies_are_unlike_each_other(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for family in range(6):
        text = [rng.choice(vocabulary) for _ in range(120)]
        docs.append(text)
        for _ in range(40):
            own = list(text)
            for _ in range(rng.choice([1, 2, 3, 5, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs.append(own)
    rng.shuffle(docs)
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    assert found(spark, docs) == brute(docs)


def test_a_chain_and_a_passage_that_many_share(spark):
    words = [f"c{k}" for k in range(260)]
    chain = [(k, " ".join(words[k * 4 : k * 4 + 100])) for k in range(30)]
    passage = " ".join(f"p{k}" for k in range(60))
    shared = [(100 + k, passage + " " + " ".join(f"o{k}x{j}" for j in range(12 + k % 30))) for k in range(90)]
    docs = chain + shared
    assert found(spark, docs) == brute(docs)


def test_the_threshold_itself(spark):
    # 102 words make 100 shingles; 17 lie beyond the common 85 or just one more does.
    base = [f"b{k}" for k in range(87)]
    docs = [(1, " ".join(base)), (2, " ".join([*base, *[f"x{k}" for k in range(15)]])), (3, " ".join(f"e{k}" for k in range(87))), (4, " ".join([*[f"e{k}" for k in range(87)], *[f"y{k}" for k in range(16)]]))]
    assert brute(docs)[2][1] == 1 and brute(docs)[4][1] == 4
    assert found(spark, docs) == brute(docs)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one"), (7, "w " * 50_000), (8, "w " * 49_000), (9, "x" * 200_000), (None, "one two"), (4, "one two")]
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], KIND + ", key long, n int, sig string")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.minhash_components(df).collect()]
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (None, 1, 4, False), (4, 1, 4, True)]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    only = minhash.minhash_components(spark.createDataFrame([(None, "a b c d"), (None, None)], KIND)).collect()
    assert [(r["component_id"], r["kept"]) for r in only] == [(None, True)] * 2
    assert minhash.minhash_components(spark.createDataFrame([], KIND)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.85, 0.95):
        common, rest = int(2000 * share), 2000 - int(2000 * share)
        every = np.sort(rng.integers(0, 2**64, 2000, np.uint64))
        a, b = rng.permutation(every)[: common + rest // 2], None
        b = np.setdiff1d(every, a)
        b = np.concatenate((a[:common], b))
        least = minhash.minima(np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((least[0] == least[1]).mean() - true) < 0.11
        x = minhash.packed(least).view(np.uint64)
        half = minhash._LONGS
        gap = sum(int(v).bit_count() for v in (x[0, :half] ^ x[1, :half]) | (x[0, half:] ^ x[1, half:]))
        assert abs(gap / least.shape[1] - 0.75 * (1 - true)) < 0.11
    assert minhash.allowed_gap(85) < 0.75 * 0.5 * minhash.BANDS * minhash.ROWS


def test_short_rows_and_sets():
    hashes, sizes = minhash.shingle_sets(pa.array(["a b c a b c a", None, "A", "a b", "a b c"]), 3)
    assert sizes.tolist() == [3, 0, 1, 1, 1] and hashes[5] in hashes[:3] and hashes[4] != hashes[5]
