"""Pair queries compare all vectors of a label."""

from __future__ import annotations

import itertools
import math

from cuesmith.catalog import queries

from .compare import SF_DIR


def vectors(spark):
    return {r["vec_id"]: (r["label"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}


def wanted(spark):
    own = vectors(spark)
    return {(a, b) for a, b in itertools.combinations(sorted(own), 2) if own[a][0] == own[b][0]}


def test_envelope_pairs_are_all_pairs(spark):
    own = vectors(spark)
    rows = {(r["left_id"], r["right_id"]): r["similarity"] for r in queries()["j06_envelope_pairs"](spark, SF_DIR).collect()}
    assert set(rows) == wanted(spark)

    def cosine(a, b):
        x, y = ([t - sum(v) / len(v) for t in v] for v in (a, b))
        return (math.fsum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(math.fsum(p * p for p in x) * math.fsum(q * q for q in y)) + 1) / 2

    assert all(math.isclose(s, cosine(own[a][1], own[b][1]), abs_tol=1e-9) for (a, b), s in rows.items())


def test_fingerprint_pairs_are_all_pairs(spark):
    rows = queries()["x11_fingerprint_pairs"](spark, SF_DIR).select("left_id", "right_id").collect()
    assert {(r["left_id"], r["right_id"]) for r in rows} == wanted(spark) and len(rows) == len(wanted(spark))
