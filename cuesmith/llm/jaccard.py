"""N-gram Jaccard join with vertical partitioning.

All shingles have one global order (rarest first).  The order is cut into
fragments; a first pass over the fragments counts, for each shingle, in how many
different sets it occurs, and for each set how many of its shingles occur
elsewhere.  A set that links must share the threshold's part of its shingles, so
most sets leave here.  Shingles that very many texts hold, found on a sample of
texts, need no such count and are dealt to many groups.  What stays is joined on prefixes of the order, and each
candidate pair's overlap is counted fragment by fragment and summed per pair.

Equal sets form one class and are joined as one.  Within a posting list not all
pairs are made: sets first meet the list's hub, and after components of those
links are known, only pairs across components remain, which are all tried unless
bounds rule them out.  Of two sets counted against one hub, the shingles within
the hub bound their overlap; if that is too little, they must share a shingle
outside it and are met there.  No link that could join two components is lost,
and no list, candidate or partner count is capped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, drop, give_back, parts, take_over
from .shingles import mix, shingle_sets, slices

#: Vertical fragments in which a pair's overlap is counted.
PIECES = 8
#: Bytes that a fragment holds, about; there are as many as that takes.  In small
#: fragments a class stands for few shingles each time, so its key costs more than they.
FRAGMENT_BYTES = 48 << 20
#: Bytes of a shingle alone in its fragment: its own, its class's key and two counts, compressed.
SHINGLE_BYTES = 16
#: Shingles that are sorted at a time: of a fragment by their hash, or a bucket's classes whole.
STEP = 1 << 20
#: A shingle of about so many texts spreads over groups; with its classes it takes up to 13 bytes of each.
HOT = 1 << 16
#: One of so many texts, by hash, is read to find such shingles.
SAMPLED = 64
#: So many shingles may be listed as frequent: 8 MB.
MOST_HOT = 1 << 20
_U = np.uint64


def _class_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set, the same for equal sets."""
    keys = np.zeros(len(sizes), _U)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        keys[full] = mix(np.add.reduceat(mix(hashes), starts) + sizes[full].astype(_U))
    return keys


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, key): the size of each document's shingle set, and a key that
    documents of equal sets share (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("jaccard")
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hashes, sizes = shingle_sets(batch.column(1))
            keys = pa.array(_class_keys(hashes, sizes).view(np.int64), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), keys], ["doc", "n", "key"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc long, n long, key long")


def _classes_once(column: pa.Array, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the column's texts, those of a class that this task has not seen:
    shingles, each one's row, the rows' keys and sizes, and the classes seen by now."""
    hashes, sizes = shingle_sets(column)
    keys = _class_keys(hashes, sizes)
    first = np.zeros(len(sizes), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    first &= (sizes > 0) & ~np.isin(keys, seen)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    kept = first[rows]
    return hashes[kept], rows[kept], keys, sizes, np.union1d(seen, keys[first])


def _frequent(docs: DataFrame, text_col: str, total: int) -> np.ndarray:
    """Shingles that about HOT texts or more hold, the most frequent last; counted in
    one of SAMPLED texts.  They only spread over more groups: results do not depend
    on which they are, but one run must use one list.  Of total shingles, at most
    MOST_HOT can be listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("jaccard")
        seen = np.zeros(0, _U)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            hashes, _, _, _, seen = _classes_once(batch.column(0), seen)
            own, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "c"])
        give_back()

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = texts.mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))
    found = counted.where(F.col("c") >= max(HOT, total // MOST_HOT) // SAMPLED).orderBy("c", "hash").select("hash").collect()
    return np.array([r[0] for r in found], np.int64).view(_U)


def _fragments(docs: DataFrame, text_col: str, count: int, frequent: np.ndarray) -> DataFrame:
    """Sets cut at the fragments' bounds.  A batch sends one row for each fragment
    that it has shingles of, and a task every class once, whatever number of its
    copies it holds.  Frequent shingles are tokens of one more fragment, dealt to
    as many groups again by shingle and class, so none gathers in a group."""
    by_hash = np.argsort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("jaccard")
        seen = np.zeros(0, _U)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            hashes, rows, keys, sizes, seen = _classes_once(batch.column(0), seen)
            if not len(hashes):
                continue
            fragment = (((hashes >> _U(32)) * _U(count)) >> _U(32)).astype(np.int32)
            low = hashes.copy()
            if len(frequent):
                spot = by_hash[np.minimum(np.searchsorted(frequent, hashes, sorter=by_hash), len(frequent) - 1)]
                hot = np.flatnonzero(frequent[spot] == hashes)
                low[hot] = spot[hot]
                fragment[hot] = count + (mix(keys[rows[hot]] ^ mix(hashes[hot])) % _U(count)).astype(np.int32)
            order = np.argsort(fragment, kind="stable")
            low, rows, fragment = low[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], rows[order], fragment[order]
            bounds = np.flatnonzero(np.concatenate(([True], fragment[1:] != fragment[:-1], [True]))).tolist()
            out: list[list] = [[], [], [], [], []]
            for at, end in itertools.pairwise(bounds):
                own, counts = np.unique(rows[at:end], return_counts=True)
                for column, value in zip(out, (int(fragment[at]), keys[own].tobytes(), sizes[own].astype("<u4").tobytes(), counts.astype("<u4").tobytes(), low[at:end].tobytes()), strict=True):
                    column.append(value)
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["fragment", "keys", "sizes", "counts", "low"])
        give_back()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "fragment int, keys binary, sizes binary, counts binary, low binary")


def _unpack(low: bytes) -> np.ndarray:
    wide = np.zeros((len(low) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _shared(keys: np.ndarray, sizes: np.ndarray, low: np.ndarray, frequent: bool) -> tuple[np.ndarray, ...]:
    """Keys, sizes, shingles and rarity of each class's shingles that another class has."""
    order = np.lexsort((keys, low))
    keys, sizes, low = keys[order], sizes[order], low[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (keys[1:] != keys[:-1])
    keys, sizes, low = keys[fresh], sizes[fresh], low[fresh]
    if frequent:
        return keys, sizes, low, np.full(len(low), 255, np.uint8)
    counts = np.diff(np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1], [True]))))
    spread = np.repeat(counts, counts)
    many = spread > 1
    return keys[many], sizes[many], low[many], np.minimum(254, 8 * np.log2(spread[many])).astype(np.uint8)


def _bucket_rows(keys: np.ndarray, sizes: np.ndarray, low: np.ndarray, rarity: np.ndarray, buckets: int, fragment: int) -> Iterator[tuple]:
    """A row for each bucket of classes, where a class stands once with the number
    of its shingles there."""
    bucket = (mix(keys) % _U(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    keys, sizes, low, rarity, bucket = keys[order], sizes[order], low[order], rarity[order], bucket[order]
    for s, e in itertools.pairwise(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))).tolist()):
        own, at, each = np.unique(keys[s:e], return_index=True, return_counts=True)
        yield int(bucket[s]), fragment, own.tobytes(), sizes[s:e][at].astype("<u4").tobytes(), each.astype("<u4").tobytes(), low[s:e].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), rarity[s:e].tobytes()


def _shared_in_fragment(count: int, buckets: int):
    """For a fragment: which shingles occur in two classes or more, dealt to
    buckets of classes.  They are 40 bits of hash in the row's fragment.  Groups
    from ``count`` on hold frequent shingles, last in the order, by their place in
    the list; all of them go on.  A fragment's bytes are held as they came, and
    about STEP of its shingles are looked at in one go, by their hash."""
    most = STEP

    def run(group: pd.DataFrame) -> pd.DataFrame:
        fragment = int(group.fragment.iloc[0])
        frequent = fragment >= count
        steps = _U(-(-sum(map(len, group["low"])) // (5 * most)))
        rows, held, waiting = [], [], 0
        for step in range(int(steps)):
            mine = []
            for k, n, c, low in zip(group["keys"], group["sizes"], group["counts"], group["low"], strict=True):
                low, counts = _unpack(low), np.frombuffer(c, "<u4")
                here = np.flatnonzero((low % steps if frequent else (low * steps) >> _U(40)) == step)
                mine.append((np.repeat(np.frombuffer(k, _U), counts)[here], np.repeat(np.frombuffer(n, "<u4"), counts)[here], low[here]))
            held.append(_shared(*map(np.concatenate, zip(*mine, strict=True)), frequent))
            waiting += len(held[-1][0])
            if waiting >= most or step + 1 == steps:
                if waiting:
                    rows += _bucket_rows(*map(np.concatenate, zip(*held, strict=True)), buckets, min(fragment, count))
                held, waiting = [], 0
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "fragment", "keys", "sizes", "counts", "low", "rarity"])

    return run


def _candidates_of_bucket(part: int, whole: int):
    """For a bucket of classes: those whose shared shingles suffice for a link,
    with their shared shingles in global order and cut into pieces.  Tokens are
    the fragment's number and 40 bits of hash."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        counts = [np.frombuffer(x, "<u4") for x in group["counts"]]
        spread = lambda column, kind: np.concatenate([np.repeat(np.frombuffer(x, kind), c) for x, c in zip(group[column], counts, strict=True)])
        keys, sizes = spread("keys", _U), spread("sizes", "<u4").astype(np.int64)
        tokens = np.concatenate([(_U(f) << _U(40)) | _unpack(x) for f, x in zip(group["fragment"], group["low"], strict=True)])
        rarity = np.concatenate([np.frombuffer(x, np.uint8) for x in group["rarity"]])
        _, at, inverse, held = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        need = -(-sizes[at] * part // whole)
        stays = (held >= need)[inverse]
        keys, tokens, sizes, rarity = keys[stays], tokens[stays], sizes[stays], rarity[stays]
        order = np.lexsort((tokens, rarity, keys))
        keys, tokens, sizes = keys[order], tokens[order].view(np.int64), sizes[order]
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, int)
        rows = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            own, n = tokens[s:e], int(sizes[s])
            need = -(-n * part // whole)
            piece = (own % PIECES).astype(int)
            rows.append((int(keys[s : s + 1].view(np.int64)[0]), n, e - s, own[: e - s - need + 1], [np.sort(own[piece == p]) for p in range(PIECES)]))
        return pd.DataFrame(rows, columns=["key", "n", "shared", "prefix", "pieces"])

    return run


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, c, outside): overlaps counted in each vertical fragment and
    summed, and those of a's shared shingles that b lacks."""
    a = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("pieces").alias("pa"))
    b = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pieces").alias("pb"))
    each = F.zip_with("pa", "pb", lambda x, y: F.size(F.array_intersect(x, y)))
    lacked = F.flatten(F.zip_with("pa", "pb", F.array_except))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", F.aggregate(each, F.lit(0), lambda s, x: s + x).cast("long").alias("c"), lacked.alias("outside"))


def _linked(overlaps: DataFrame, part: int, whole: int) -> DataFrame:
    return overlaps.where(F.col("c") * whole >= (F.col("na") + F.col("nb") - F.col("c")) * part).select("a", "b")


def _sides(rows: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows twice, named x_ and y_ but for the keys they meet on; only keys of several roots."""
    split = rows.groupBy(*on).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(*on)
    rows = rows.join(split, on, "left_semi")
    return tuple(rows.select(*on, *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in on]) for side in "xy")


def _across(posts: DataFrame, counted: DataFrame, roots: DataFrame, part: int, whole: int) -> DataFrame:
    """(a, b): the pairs of different components that may link by all bounds."""
    roots = roots.withColumnRenamed("node", "key")
    suffices = lambda c: c * (whole + part) >= (F.col("x_n") + F.col("y_n")) * part
    alike = (F.col("x_root") < F.col("y_root")) & (F.col("x_n") * whole >= F.col("y_n") * part) & (F.col("y_n") * whole >= F.col("x_n") * part)
    # Each set's pivot is the hub that it was counted against, or itself.
    pivots = counted.select(F.col("a").alias("key"), F.col("b").alias("pivot"), F.col("c").alias("held"))
    known = posts.join(roots, "key", "left").join(pivots, "key", "left")
    known = known.select("token", "key", "n", "shared", "rank", F.coalesce("root", "key").alias("root"), F.coalesce("pivot", "key").alias("pivot"), F.coalesce("held", "shared").alias("held"))
    x, y = _sides(known, ["token"])
    # A pair's overlap is at most what both have before and after this token of the order.
    most = F.least("x_rank", "y_rank") + F.least(F.col("x_shared") - F.col("x_rank"), F.col("y_shared") - F.col("y_rank"))
    within = (F.col("x_pivot") != F.col("y_pivot")) | suffices(F.least("x_held", "y_held"))
    met = x.join(y, "token").where(alike & suffices(most) & within).select(F.col("x_key").alias("a"), F.col("y_key").alias("b"))
    # Of one pivot: what both have within it, and what they share outside it.
    lone = counted.select(F.col("a").alias("key"), F.col("b").alias("pivot"), F.col("na").alias("n"), F.col("c").alias("held"), F.size("outside").alias("lone"), F.explode("outside").alias("token"))
    lone = lone.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    x, y = _sides(lone, ["pivot", "token"])
    most = F.least("x_held", "y_held") + F.least("x_lone", "y_lone")
    apart = x.join(y, ["pivot", "token"]).where(alike & suffices(most)).select(F.col("x_key").alias("a"), F.col("y_key").alias("b"))
    return met.unionByName(apart).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row for each row of docs: its id as ``doc_id``, ``n_shingles`` and
    ``component_id``, the smallest id that its links reach.

    Two documents link when 100 * intersection >= percent * union of their sets
    of distinct 5-word shingles.  A text of 1 to 4 words has one shingle, its
    whole word sequence; a null text or one without words has an empty set and
    links with nothing.  Repeated rows link as copies; a null id takes part but
    is never the smallest (a component of null ids has a null component_id).
    An empty table gives an empty result.  Other columns are ignored.

    Shingles are compared by 40 bits of hash besides their fragment: two given
    sets of 500 differ in count from the true one with a chance of about 1e-9.
    """
    spark = docs.sparkSession
    part, whole = percent, 100
    rows = cut(shingle_classes(docs, id_col, text_col))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("doc").alias("first"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    n = max(parts(spark), -(-SHINGLE_BYTES * total // FRAGMENT_BYTES))
    buckets = max(parts(spark), -(-total // STEP))
    sets = cut(
        _fragments(docs, text_col, n, _frequent(docs, text_col, total))
        .groupBy("fragment")
        .applyInPandas(_shared_in_fragment(n, buckets), "bucket int, fragment int, keys binary, sizes binary, counts binary, low binary, rarity binary")
        .groupBy("bucket")
        .applyInPandas(_candidates_of_bucket(part, whole), "key long, n long, shared long, prefix array<long>, pieces array<array<long>>")
    )
    posts = cut(sets.select("key", "n", "shared", F.posexplode("prefix").alias("rank", "token")))
    # A list's hub is its set with the fewest shingles of its own: of near copies, the one that the others were made from.
    hubs = posts.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("shared")).alias("lone"), "key")).alias("least"), F.count("*").alias("c")).where("c > 1").select("token", F.col("least.key").alias("hub"), F.col("least.lone").alias("lone"))
    met = posts.join(hubs, "token").where("key <> hub").groupBy("key", "hub").agg(F.first("lone").alias("lone"), F.count("*").alias("count"))
    first = met.groupBy("key").agg(F.max_by("hub", F.struct(-F.col("lone"), "count", "hub")).alias("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    counted = cut(_overlaps(first, sets))
    links = _linked(counted, part, whole)
    roots = components(links)
    rest = cut(_across(posts, counted, roots, part, whole))
    links = links.unionByName(_linked(_overlaps(rest, sets), part, whole))
    roots = components(links).withColumnRenamed("node", "key")
    drop(sets, posts, counted, rest)  # roots are written
    joined = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    to = joined.join(smallest, "root").select("key", "component_id")
    full = rows.where("key is not null").join(to, "key")
    bare = rows.where("key is null").withColumn("component_id", F.col("doc"))
    return full.select("doc", "n", "component_id").unionByName(bare.select("doc", "n", "component_id")).toDF("doc_id", "n_shingles", "component_id")
