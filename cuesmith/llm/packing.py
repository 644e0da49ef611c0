"""Best-fit packing by planning over the histogram of lengths.

The plan sees only how many pieces of each length there are (at most as many
counts as a sequence has tokens), never documents.  It is a list of runs of equal
slots; a piece takes the slot that has its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, give_back, keep, parts, take_over
from .shingles import slices

SEQUENCE = 4096
#: The id that ends each document.
END = 1
#: Slots of one stretch of a run.
STRETCH = 1024
#: Entries of each of a task's two generations of remembered words.
REMEMBERED = 500_000
#: Words of letters that are encoded at a time, and bytes of text that are taken together.
TOGETHER, PART = 64, 1 << 20


def _stays_letter(c: str) -> bool:
    """Whether c is a letter, and is nothing else when composed and in lower case."""
    return c.isalpha() and (c.isascii() or unicodedata.normalize("NFC", c).lower().isalpha())


class WordIds:
    """Token ids, as little-endian bytes, of the words between blanks.  The
    vocabulary drops white space, so a text's ids are its words' ids in turn."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism here
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each word with its ids.  Words of letters are encoded many at a time, one
        after another, and parted where a token ends a word; where not each has
        just one such end, they are encoded one by one, as all other words are."""
        plain, alone = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        for at in range(0, len(plain), TOGETHER):
            own = plain[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(own):
                raw = ids.tobytes()
                yield from zip(own, [raw[s:e] for s, e in zip([0, *ends], ends, strict=False)], strict=True)
            else:
                alone += own
        for word, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield word, array("I", found.ids).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        """Each text's ids; words not seen lately are encoded in one call."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {"": b""}
        young, old = self.young, self.old
        wanted, parted = set(), []
        for word in set().union(*split).difference(young):
            if word in old:
                young[word] = old[word]
                continue
            # A mark after a letter is always a token of its own, and case is folded.
            mark = word[-1] if word[-1] in ",." and _stays_letter(word[-2:-1]) else ""
            base = word[:-1] if mark else word
            if "A" <= base[0] <= "Z":
                base = base[0].lower() + base[1:]
            wanted.add(base)
            parted.append((word, base, mark))
        young.update(self.encode([w for w in {*wanted, ",", "."} if w not in young]))
        for word, base, mark in parted:
            young[word] = young[base] + young[mark]
        return [b"".join(map(young.__getitem__, words)) for words in split]


@lru_cache(2)
def word_ids(path: str | None = None) -> WordIds:
    return WordIds(path)


keep("packing", word_ids.cache_clear)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, size: int, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, the ids."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("packing")
        coder, end = word_ids(vocabulary), END.to_bytes(4, "little")
        for batch in batches:
            for rows in slices(batch, 1, PART):
                out: list[list] = [[], [], [], [], []] + [[]] * with_ids
                for doc, ids in zip(rows.column(0).to_pylist(), coder.texts([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    ids += end
                    for piece, k in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[k : k + 4 * size]
                        for column, value in zip(out, (doc, piece, k // 4, len(own) // 4, zlib.crc32(own), own), strict=False):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=False)], [x.split()[0] for x in kind.split(", ")])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, kind)


def plan_slots(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts, longest first: (length, first rank, how many, first
    sequence, offset) runs; in a run, each next rank is in the next sequence."""
    open_by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                first, many, room = sequences, -(-left // (size // length)), size
                sequences += many
            else:
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.remove(room)
            each = min(room // length, -(-left // many))
            while each and left:
                take = min(many, left)
                plan.append((length, rank, take, first, size - room))
                rank, left = rank + take, left - take
                if take < many:
                    _open(open_by_room, rooms, room, first + take, many - take)
                room, many = room - length, take
                each = min(room // length, each - 1)
            _open(open_by_room, rooms, room, first, many)
    return plan


def _open(open_by_room: dict, rooms: list[int], room: int, first: int, many: int) -> None:
    if room > 0 and many:
        if room not in open_by_room:
            open_by_room[room] = []
            rooms.append(room)
        open_by_room[room].append((first, many))


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for
    each piece of each row of docs.

    A document is its token ids and then END; a null or empty text is END alone.
    Only documents longer than size are cut.  Equal lengths take slots by
    (doc_id, piece); repeated rows are packed each on its own; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, id_col, text_col, size, vocabulary))
    # Ranks within a length: by salted buckets, for one length may hold a third of all pieces.
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts(spark))))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(order) - 1)
    tallies = salted.groupBy("length", "salt").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = tallies.select("length", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = spark.createDataFrame(plan_slots(counts, size), "length long, rank long, many long, first long, offset long")
    # A run of any number of slots is dealt out in stretches and only then written out.
    stretches = runs.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1, F.lit(STRETCH).cast("long")))).repartition(parts(spark), "length", "rank", "from")
    steps = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + STRETCH, F.col("many")) - 1))
    slots = stretches.withColumn("k", steps).select("length", (F.col("rank") + F.col("k")).alias("rank"), (F.col("first") + F.col("k")).alias("sequence_id"), "offset")
    return ranked.join(slots, ["length", "rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
