"""Byte-level BPE as a monoid of token sequences.

A pre-token's bytes are cut in halves, again and again, down to LEAF bytes; leaves
are merged by the rank table, and neighbours are joined up the tree.  A join
re-encodes a window around the seam and widens it until the tokens on both of its
rims fit the ones outside.  Two tokens fit if encoding their bytes together gives
the two again; a sequence whose every neighbouring pair fits is the encoding of its
bytes, so what is outside the window is final.  Pre-tokens are encoded apart, hence
a text's encoding is their concatenation; decoding concatenates neighbours up a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, take_over
from .shingles import slices

LEAF = 2
#: Entries of each of a task's two generations of remembered pre-tokens, and of the remembered parts of at most PART bytes.
REMEMBERED, PART = 120_000, 8
#: From so many bytes on a window's merges are kept in a heap.
HEAPED = 48


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import regex

        self.pattern = regex.compile(pattern)
        self.leaf = leaf
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.digits_of = [str(i).encode() for i in range(len(self.bytes_of))]
        self.single = [bytes([b]) for b in range(256)]
        self.fits = lru_cache(1 << 17)(self._fits)
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}

    def _fits(self, left: int, right: int) -> bool:
        return self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def merged(self, raw: bytes) -> list[int]:
        """The merges of a leaf or window from its single bytes on, lowest rank first."""
        if len(raw) >= HEAPED:
            return self._merged_by_heap(raw)
        rank_of = self.ranks.get
        held = [self.single[b] for b in raw]
        none = len(self.bytes_of)
        pairs = [rank_of(a + b, none) for a, b in zip(held, held[1:], strict=False)]
        while pairs:
            rank = min(pairs)
            if rank == none:
                break
            i = pairs.index(rank)
            held[i : i + 2] = [self.bytes_of[rank]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank_of(held[i - 1] + held[i], none)
            if i < len(pairs):
                pairs[i] = rank_of(held[i] + held[i + 1], none)
        return [self.ranks[x] for x in held]

    def _merged_by_heap(self, raw: bytes) -> list[int]:
        rank_of, n = self.ranks.get, len(raw)
        held: list[bytes] = [self.single[b] for b in raw]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := rank_of(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if not held[i] or j == n or held[i] + held[j] != self.bytes_of[rank]:
                continue  # one of the two has been merged meanwhile
            held[i], held[j], k = self.bytes_of[rank], b"", after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := rank_of(held[i] + held[k])) is not None:
                    heappush(heap, (rank, i))
            if (h := before[i]) >= 0 and (rank := rank_of(held[h] + held[i])) is not None:
                heappush(heap, (rank, h))
        return [self.ranks[x] for x in held if x]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two sides' bytes, from the sides' encodings."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self.merged(b"".join([self.bytes_of[t] for t in left[i:] + right[:j]]))
            if (i == 0 or self.fits(left[i - 1], window[0])) and (j == len(right) or self.fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            reach *= 2

    def encode_bytes(self, raw: bytes) -> list[int]:
        n = len(raw)
        if n <= self.leaf:
            return self.merged(raw)
        if n > PART:
            # Halves of long runs end at powers of two, where the tokens of a repeated pattern mostly end too.
            half = n // 2 if n <= 64 else 1 << ((n - 1).bit_length() - 1)
            return self.join(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))
        ids = self.parts.get(raw)
        if ids is None:
            ids = self.join(self.encode_bytes(raw[: n // 2]), self.encode_bytes(raw[n // 2 :]))
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            self.parts[raw] = ids
        return ids

    def __missing__(self, token: str) -> list[int]:
        ids = self.old.get(token)
        if ids is None:
            ids = self.encode_bytes(token.encode())
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        if len(token) <= 64:
            self.young[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        seen, miss = self.young.get, self.__missing__
        return list(chain.from_iterable([seen(m) or miss(m) for m in self.pattern.findall(text)]))

    def decode(self, ids: list[int]) -> bytes:
        level = [self.bytes_of[i] for i in ids]
        while len(level) > 1:
            pairs = [a + b for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[-1:] if len(level) % 2 else pairs
        return level[0] if level else b""


@lru_cache(2)
def encoder(path: str | None = None) -> TreeEncoder:
    """The encoder of a rank file (lines of base64 bytes and rank), one for each Python process."""
    import base64

    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return TreeEncoder(ranks, public_tokenizers.PATTERN)


keep("bpe", encoder.cache_clear)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text.  A null text
    counts as empty and has no ids; nulls in other columns, repeated rows and
    further columns change nothing; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("bpe")
        coder = encoder(ranks)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids = [coder.encode(t) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """As encode_texts, with n_tokens and SHA-256 digests in place of the ids and
    bytes: ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the
    bytes that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("bpe")
        coder = encoder(ranks)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join(map(coder.digits_of.__getitem__, ids))).hexdigest())
                of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
