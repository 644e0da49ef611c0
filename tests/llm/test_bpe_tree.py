"""The tree of joins: every vocabulary entry, long runs, and what passes through it."""

from __future__ import annotations

import random

import pytest

from cuesmith.llm import bpe


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})


def test_every_vocabulary_entry_is_its_own_encoding():
    coder = bpe.encoder()
    assert [raw for raw, rank in coder.ranks.items() if coder.encode_bytes(raw) != [rank]] == []


@pytest.mark.parametrize("heaped", (2, 48, 10**9))
def test_joins_of_random_tokens(library, monkeypatch, heaped):
    monkeypatch.setattr(bpe, "HEAPED", heaped)
    r, coder = random.Random(heaped), bpe.TreeEncoder(bpe.encoder().ranks, library._pat_str)
    for _ in range(3000):
        raw = b"".join(coder.bytes_of[r.randrange(len(coder.bytes_of))] for _ in range(r.randint(1, 6)))
        assert coder.encode_bytes(raw) == library._encode_single_piece(raw)


def test_long_runs(library):
    coder = bpe.encoder()
    for text in ("x" * 100_000, "ab" * 50_001, "=-" * 30_000 + "=", "日本" * 9999, "a" * 4097, "the" * 5000):
        ids = coder.encode_bytes(text.encode())
        assert ids == library._encode_single_piece(text) and coder.decode(ids) == text.encode()


def test_most_pre_tokens_pass_a_join(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    coder = bpe.encoder()
    pieces = [p for t in texts for p in coder.pattern.findall(t)]
    assert sum(len(p.encode()) > bpe.LEAF for p in pieces) > 0.8 * len(pieces)
    joins = []
    fresh = bpe.TreeEncoder(coder.ranks, coder.pattern.pattern)
    monkeypatch.setattr(fresh, "join", lambda a, b: joins.append(1) or a + b)
    assert any(fresh.encode(t) != coder.encode(t) for t in texts) and joins
