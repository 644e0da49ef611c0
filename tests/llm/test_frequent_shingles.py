"""Shingles listed as frequent spread over groups of their own; links stay the same."""

import collections
import random

import pytest

from cuesmith.llm import jaccard

from .test_operators import plain_components


def near_copies(seed):
    """Groups of copies and near copies, some with one passage that every text holds."""
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(r.randrange(20, 90))]
        for _ in range(12):
            own = list(base)
            for at in r.sample(range(len(own)), r.randrange(0, 4)):
                own[at] = f"e{r.randrange(5)}"
            rows.append((len(rows), " ".join(own) + (" " + passage if r.random() < 0.8 else "")))
    return [*rows, (900, passage), (901, passage.upper()), (902, None), (903, "a b")]


@pytest.mark.parametrize(("hot", "step", "seed"), ((1, 1 << 20, 0), (3, 40, 1), (40, 300, 0)))
def test_same_links_with_frequent_shingles(spark, monkeypatch, hot, step, seed):
    monkeypatch.setattr(jaccard, "STEP", step)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(jaccard._frequent(docs, "text", 0)) > 0
    got = collections.Counter(tuple(x) for x in jaccard.jaccard_components(docs).collect())
    assert got == plain_components(rows)


def test_a_passage_of_every_text_is_found_in_the_sample(spark):
    """With the parameters as they are: one passage in 80,000 texts is listed, what is rare is not."""
    docs = spark.range(80_000).selectExpr("id AS doc_id", "concat('all of us share this passage ', id, ' tail') AS text")
    found = jaccard._frequent(docs, "text", 6 * 80_000)
    assert 1 <= len(found) <= 3


def test_a_task_sends_a_class_once(spark):
    docs = spark.range(0, 3000, 1, 2).selectExpr("id AS doc_id", "'one two three four five six seven' AS text")
    sent = jaccard._fragments(docs, "text", 4, jaccard._frequent(docs, "text", 9000))
    assert sent.selectExpr("sum(length(low)) AS n").first()["n"] == 2 * 3 * 5
