"""The pipeline against its stages' plain counterparts on the smallest table."""

from __future__ import annotations

import collections
import pathlib
import re

import pytest

import corpus_pipeline as pipeline
from cuesmith.llm import entries, language, quality, secret_scan, shared

from ..compare import differences
from .test_operators import plain_components

SF = "/root/testdata/sf0.001"


def test_stages_names_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality_rules", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert dict(out.dtypes) == dict(docs.dtypes)


def test_run_keeps_what_the_stages_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"] for r in language.identify(docs, language.fit(docs)).collect() if r["lang_pred"] != "und" and r["score"] >= pipeline.LEAST_SCORE}
    first = docs.where(docs.doc_id.isin(list(lang)))
    good = {r["doc_id"] for r in quality.quality_rules(first).collect() if r["kept"]}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    one_each = {d for d, _, least in plain_components(list(text.items())) if d == least}
    got = collections.Counter(r["doc_id"] for r in pipeline.run(spark, SF).collect())
    assert set(got) == one_each


def test_secrets_are_masked_and_lengths_follow(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pipeline.mask_secrets(spark, docs, SF).collect():
        want = re.sub(r'(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}|AKIA[A-Z0-9]{16}', secret_scan.MASK, before[r["doc_id"]])
        assert r["text"] == want and r["n_chars"] == len(want)


def test_stages_on_odd_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (3, "the cat sat on the mat and saw a big red dog run by", "en", None, 50), (3, "the cat sat on the mat and saw a big red dog run by", "en", None, 50)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, kind)
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, SF).collect() is not None


def test_every_operator_has_one_query():
    assert [re.match(r"op(\d+)_", n)[1] for n in entries.queries()] == [str(i) for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_like_its_sql(spark, name):
    assert differences(spark, SF, entries.queries()[name], entries.oracle_sql()[name]) == ""


def test_only_what_the_result_reads_is_left(spark):
    from urllib.parse import urlparse

    place = pathlib.Path(urlparse(shared.shared_folder(spark)).path)
    before = {p.name for p in place.iterdir()} if place.exists() else set()
    out = pipeline.run(spark, SF)
    read = {f.rsplit("/", 2)[-2] for f in out.inputFiles()}
    left = {p.name for p in place.iterdir()} - before
    # The last stage's pieces, which the result reads, and its input.
    assert read <= left and len(left - read) <= 1
    assert out.count() > 0
