"""Word and shingle hashing over Arrow text buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as
a-z.  Everything is computed by numpy on the UTF-8 buffer that Arrow hands to
the task, in slices of at most SLICE bytes (a longer single word is hashed by
itself), so memory follows the batch and not the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

WIDTH = 5
SLICE = 1 << 20
LONG_WORD = 48
#: Bytes of text whose sets are held at a time.
BATCH_BYTES = 4 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = _U(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_BYTE = mix(_FOLDED.astype(_U) + _U(0x51ED270B))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (nulls: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of at most so many bytes of text, BATCH_BYTES
    unless given (a longer row alone)."""
    most = most or BATCH_BYTES
    offsets = text_buffer(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    out = size.astype(_U) * _STEP
    left = np.flatnonzero(size <= LONG_WORD)
    part = out[left]
    for k in range(LONG_WORD):
        keep = size[left] > k
        if not keep.all():
            out[left[~keep]] = part[~keep]
            left, part = left[keep], part[keep]
        if not len(left):
            break
        part = (part ^ _BYTE[data[start[left] + k]]) * _STEP
        part ^= part >> _U(31)
    out[left] = part
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes().lower())
    return mix(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each row."""
    data, offsets = text_buffer(texts)
    if not len(offsets) or offsets[-1] == offsets[0]:
        return np.zeros(0, _U), np.zeros(max(0, len(offsets) - 1), np.int64)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(last, at + SLICE)
        while to < last and not _SPACE[data[to]]:  # a slice ends where a word can't go on
            gap = np.flatnonzero(_SPACE[data[to : to + SLICE]])
            to = to + int(gap[0]) if len(gap) else min(last, to + SLICE)
        solid = ~_SPACE[data[at:to]]
        first = np.zeros(to - at + 1, bool)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        first[inner] = True
        begins = solid.copy()
        begins[1:] &= ~solid[:-1] | first[1:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:] | first[1:-1]
        start, end = np.flatnonzero(begins) + at, np.flatnonzero(ends) + at + 1
        hashes.append(_hash_words(data, start, end))
        rows = np.searchsorted(offsets, start, "right") - 1
        counts += np.bincount(rows, minlength=len(counts))
        at = to
    return np.concatenate(hashes), counts


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one row after another, and
    how many each row has.  A row of 1 to 4 words has its whole word sequence
    as its only shingle; a row without words has none."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    if len(words) >= WIDTH:
        n = len(words) - WIDTH + 1
        rolled = words[:n] * _STEP
        for k in range(1, WIDTH):
            rolled = (rolled ^ (rolled >> _U(33))) + words[k : k + n]
            rolled *= _STEP
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, _U)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        c = counts[i]
        if c >= WIDTH:
            own = np.sort(rolled[starts[i] : ends[i] - WIDTH + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif c:
            value = int(c) * 0xE7037ED1A0B428DB % 2**64
            for w in words[starts[i] : ends[i]].tolist():
                value = ((value ^ (value >> 30)) * int(_STEP) + w) % 2**64
            own = mix(np.array([value], _U))
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), sizes
