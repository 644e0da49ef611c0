"""Near duplicates by MinHash.

A set's signature is its minimum under each of BANDS * ROWS universal hashes.
Sets that agree in all minima of a band meet in its bucket.  In a bucket, sets
first meet the most popular one, which of a family of copies is the one that the
others were made from; what they share with it is counted on full sets, and links
are made to components by alternating stars.  After that only pairs of different
components are left in a bucket, and of two sets counted against one hub only those
that share something outside it, or that it holds almost whole.  The most alike
pair of each two components is tried first, then, of what is still apart, every
pair.  A pair is taken up for confirmation on full sets unless its signatures
differ more than those of linked sets ever do, or its sizes do.

At the threshold two sets miss each other in every band with a chance of about
1e-8 (a similarity of 0.85: (1 - 0.85 ** 6) ** 40); nothing else loses a link, and
no bucket, candidate or partner count is capped.  Equal sets are one class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, drop, give_back, take_over
from .shingles import mix, slices, word_hashes

WIDTH, PERCENT = 3, 85
BANDS, ROWS = 40, 6
#: Shingles that are hashed at a time.
BLOCK = 1 << 15
#: A linked pair's signatures differ more than is allowed with this chance.
MISSED = 1e-9
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_SEEDS = np.random.default_rng(20240).integers(0, 2**32, (2, BANDS * ROWS), np.uint32)
#: h(x) = A x + B modulo 2**32, A odd, of a shingle's 32 upper bits.
_A, _B = _SEEDS[0] | np.uint32(1), _SEEDS[1]
#: Longs of a packed signature: two bits of each minimum, in two halves.
_LONGS = -(-BANDS * ROWS // 64)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of ``width`` words of each row, row
    after row, and how many each has; a shorter row has its whole sequence."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(counts)), per)
    first = np.repeat(starts, per) + np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
    last = ends[rows]
    value = np.minimum(counts[rows], width).astype(_U) * _STEP
    for k in range(width):
        inside = first + k < last
        value[inside] = (value[inside] ^ (value[inside] >> _U(33))) * _STEP + words[first[inside] + k]
    value = mix(value)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])
    return value[fresh], np.bincount(rows[fresh], minlength=len(counts))


def class_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set, the same for equal sets; 0 for an empty one."""
    keys = np.zeros(len(sizes), _U)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        keys[full] = mix(np.add.reduceat(mix(hashes ^ _STEP), starts) + sizes[full].astype(_U))
    return keys


def minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each set's minimum under each hash function; all sets hold something."""
    out = np.empty((len(sizes), BANDS * ROWS), np.uint32)
    ends = np.cumsum(sizes)
    short, at = (hashes >> _U(32)).astype(np.uint32), 0
    while at < len(sizes):
        begin = int(ends[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + BLOCK, "right")))
        block, starts = short[begin : ends[to - 1]], (ends[at:to] - sizes[at:to]) - begin
        value = np.empty_like(block)
        for k in range(BANDS * ROWS):
            np.multiply(block, _A[k], out=value)
            value += _B[k]
            out[at:to, k] = np.minimum.reduceat(value, starts)
        at = to
    return out


def buckets_of(least: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set and band, of the band and its minima."""
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _STEP, (len(least), BANDS)).copy()
    for k in range(ROWS):
        value = mix(value + least[:, k::ROWS].astype(_U))
    return value.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, the first ones in the first half of the longs."""
    bits = np.zeros((len(least), 2, _LONGS * 64), np.uint8)
    for half in range(2):
        bits[:, half, : least.shape[1]] = least >> np.uint32(30 + half) & np.uint32(1) ^ least >> np.uint32(half) & np.uint32(1)
    return np.packbits(bits.reshape(len(least), 2 * _LONGS * 64), axis=1).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc, n, key, buckets, sig) of each row.  A task gives each class's buckets
    and packed signature once, with the first of its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("minhash")
        seen = np.zeros(0, _U)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            hashes, sizes = shingle_sets(batch.column(1), width)
            keys = class_keys(hashes, sizes)
            first = _first(keys, sizes, seen)
            seen = np.union1d(seen, keys[first])
            least = minima(hashes[np.repeat(first, sizes)], sizes[first])
            lists = []
            for values in (buckets_of(least), packed(least)):
                ends = np.concatenate(([0], np.cumsum(first * values.shape[1]))).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys.view(np.int64), mask=sizes == 0), *lists], ["doc", "n", "key", "buckets", "sig"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc long, n long, key long, buckets array<long>, sig array<long>")


def _first(keys: np.ndarray, sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which rows are the first of a class that this task has not seen."""
    first = np.zeros(len(sizes), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first & (sizes > 0) & ~np.isin(keys, seen)


def _full_sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key, set): each class's full set as bytes, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("minhash")
        seen = np.zeros(0, _U)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            hashes, sizes = shingle_sets(batch.column(0), width)
            keys = class_keys(hashes, sizes)
            first = _first(keys, sizes, seen)
            seen = np.union1d(seen, keys[first])
            # A set is sorted by its upper bits, so that the 5 upper bytes of its members are a sorted set again.
            short = (hashes[np.repeat(first, sizes)] >> _U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            ends = np.concatenate(([0], np.cumsum(5 * sizes[first])))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array([short[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["key", "set"])
        give_back()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key long, set binary")


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    met = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    return met.select("a", "b", "sa", "sb")


def _counted(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, held, outside) of pairs: how many members of a's full set are in
    b's, and those that are not, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _unpacked(x.as_py()), _unpacked(y.as_py())
                inside = np.isin(x, y, assume_unique=True)
                for column, value in zip(rows, (len(x), len(y), int(inside.sum()), x[~inside].view(np.uint8).reshape(-1, 8)[:, :5].tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.binary())], ["a", "b", "na", "nb", "held", "outside"])

    return _with_sets(pairs, sets).mapInArrow(run, "a long, b long, na long, nb long, held long, outside binary")


def _linked(counted: DataFrame, percent: int) -> DataFrame:
    return counted.where(100 * F.col("held") >= percent * (F.col("na") + F.col("nb") - F.col("held"))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets have the threshold's similarity."""
    return _linked(_counted(pairs, sets).drop("outside"), percent)


def allowed_gap(percent: int) -> int:
    """How many of the minima's two bits may differ: a linked pair's exceed it with
    a chance of MISSED at most."""
    total, p = BANDS * ROWS, 0.75 * (1 - percent / 100)
    tail, m = 0.0, total
    while m and tail + (here := math.comb(total, m) * p**m * (1 - p) ** (total - m)) <= MISSED:
        tail, m = tail + here, m - 1
    return m


def _gap(x: str, y: str) -> Column:
    """In how many minima two packed signatures differ."""
    words = [(F.get(F.col(x), F.lit(k)), F.get(F.col(y), F.lit(k))) for k in range(2 * _LONGS)]
    apart = [a.bitwiseXOR(b) for a, b in words]
    counts = [F.bit_count(apart[k].bitwiseOR(apart[k + _LONGS])) for k in range(_LONGS)]
    return sum(counts[1:], counts[0])


def _alike(pairs: DataFrame, x: str, y: str, percent: int) -> DataFrame:
    """Signature verification of pairs with columns n_x, n_y, sig_x and sig_y."""
    nx, ny = F.col(f"n_{x}"), F.col(f"n_{y}")
    return pairs.where((100 * nx >= percent * ny) & (100 * ny >= percent * nx)).withColumn("gap", _gap(f"sig_{x}", f"sig_{y}")).where(F.col("gap") <= allowed_gap(percent))


def _pairs(left: DataFrame, right: DataFrame, on: list[str], percent: int, bound: Column | None = None) -> DataFrame:
    """Verified pairs (a, b, ra, rb, gap) of rows that meet on a key and are in
    different components; left and right have key, root, n and sig."""
    side = lambda df, s: df.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in on])
    met = side(left, "a").join(side(right, "b"), on).where("root_a <> root_b")
    pairs = _alike(met if bound is None else met.where(bound), "a", "b", percent)
    turned = F.col("root_a") < F.col("root_b")
    ends = [F.when(turned, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(n) for c, n in (("key", "a"), ("root", "ra"))]
    others = [F.when(turned, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(n) for c, n in (("key", "b"), ("root", "rb"))]
    return pairs.select(*ends, *others, "gap")


def _across(met: DataFrame, classes: DataFrame, counted: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b, ra, rb, gap): the verified pairs of different components that may link.

    A set's pivot is the hub that it was counted against, or itself.  Two sets of
    one pivot that it holds too little of to link by that alone must share a member
    outside it, and are met there: of a family's many members that are all unlike
    each other no pairs are made.
    """
    roots = roots.withColumnRenamed("node", "key")
    pivots = counted.select(F.col("a").alias("key"), F.col("b").alias("pivot"), "held")
    sets = classes.select("key", "n", "sig").join(roots, "key", "left").join(pivots, "key", "left")
    sets = sets.select("key", "n", "sig", F.coalesce("root", "key").alias("root"), F.coalesce("pivot", "key").alias("pivot"), F.coalesce("held", "n").alias("held"))
    known = met.select("bucket", "key").join(sets, "key")
    # A bucket's main pivot and, of its sets, the main component: all others meet all, and these not each other.
    split = known.groupBy("bucket", "pivot", "root").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    split = split.groupBy("bucket", "pivot").agg(F.sum("c").alias("c"), F.max(F.struct("c", "root")).alias("most"), F.min("least").alias("least"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    split = split.groupBy("bucket").agg(F.max(F.struct("c", "pivot", "most.root")).alias("main"), F.min("least").alias("least"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    known = known.join(split.select("bucket", "least", F.col("main.pivot").alias("main"), F.col("main.root").alias("main_root")), "bucket")
    rows = known.select("bucket", "key", "root", "n", "sig", "pivot", "held")
    suffices = lambda held, n, m: held * (100 + percent) >= (n + m) * percent
    within = suffices(F.least("held_a", "held_b"), F.col("n_a"), F.col("n_b"))
    others = _pairs(known.where(F.col("pivot") != F.col("main")).select(*rows.columns), rows, ["bucket"], percent, (F.col("pivot_a") != F.col("pivot_b")) | within)
    able = (F.col("pivot") == F.col("main")) & suffices(F.col("held"), F.col("n"), F.col("least"))
    near = _pairs(known.where(able & (F.col("root") != F.col("main_root"))).select(*rows.columns), known.where(able).select(*rows.columns), ["bucket"], percent, within)
    return others.unionByName(near).unionByName(_outside(counted, sets, roots, percent))


def _outside(counted: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The verified pairs of one pivot that share members outside it, met on the rarest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in range(0, batch.num_rows, 64):
                part = batch.slice(top, 64)
                tokens = [_unpacked(x.as_py()).view(np.int64) for x in part.column(part.num_columns - 1)]
                at = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in part.columns[:-1]], pa.array(np.concatenate(tokens))], ["pivot", "key", "root", "token"])

    known = counted.join(roots.select(F.col("key").alias("a"), "root"), "a", "left")
    posts = known.select(F.col("b").alias("pivot"), F.col("a").alias("key"), F.coalesce("root", "a").alias("root"), "outside").mapInArrow(run, "pivot long, key long, root long, token long")
    common = posts.groupBy("pivot", "token").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("pivot", "token", "c")
    held = posts.join(common, ["pivot", "token"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("tokens"))
    held = held.join(sets, "key").withColumn("lone", F.size("tokens"))
    need = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100) - F.col("held")).cast("int")
    first = held.where(F.col("lone") >= need).withColumn("token", F.explode(F.slice("tokens", F.lit(1), F.col("lone") - need + 1))).select("pivot", F.col("token.token").alias("token"), "key", "root", "n", "sig", "held", "lone")
    most = F.least("held_a", "held_b") + F.least("lone_a", "lone_b")
    bound = (F.col("key_a") < F.col("key_b")) & (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    return _pairs(first, first, ["pivot", "token"], percent, bound)


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: its id as ``doc_id``, ``n_shingles``,
    ``component_id`` (the smallest id that its links reach) and ``kept``, whether it
    is that one.

    Two documents link when 100 * intersection >= percent * union of their sets
    of distinct shingles of ``width`` words.  A text of fewer words has one
    shingle, its whole word sequence; a null text or one without words has an empty
    set, links with nothing and is kept.  Repeated rows link as copies, and rows
    repeating the smallest id are all kept; a null id takes part but is never the
    smallest (a component of null ids has a null component_id, and they are kept).
    An empty table gives an empty result.  Other columns are ignored.

    Full sets are compared by 40 bits of hash: two of 500 shingles differ in count
    from the true one with a chance of about 1e-7.
    """
    rows = cut(signatures(docs, id_col, text_col, width))
    classes = cut(rows.where(F.size("buckets") > 0).select("key", "n", "buckets", "sig").dropDuplicates(["key"]))
    posts = classes.select(F.explode("buckets").alias("bucket"), "key")
    counts = posts.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    met = cut(posts.join(counts, "bucket"))
    popular = met.groupBy("key").agg(F.sum("c").alias("pop"))
    hubs = met.join(popular, "key").groupBy("bucket").agg(F.max(F.struct("pop", "key")).alias("hub")).select("bucket", F.col("hub.key").alias("hub"))
    shared = met.join(hubs, "bucket").where("key <> hub").groupBy("key", "hub").agg(F.count("*").alias("count"))
    first = shared.groupBy("key").agg(F.max(F.struct("count", "hub")).alias("best")).select(F.col("key").alias("a"), F.col("best.hub").alias("b"))
    sets = cut(_full_sets(docs, text_col, width).join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    counted = cut(_counted(first, sets))
    links = _linked(counted, percent)
    roots = components(links)
    # Of each two components the most alike pair.
    best = cut(_across(met, classes, counted, roots, percent).groupBy("ra", "rb").agg(F.min(F.struct("gap", "a", "b")).alias("p")).select("p.a", "p.b"))
    more = cut(_confirmed(best, sets, percent))
    joined = links.unionByName(more)
    now = components(joined)
    rest = cut(_across(met, classes, counted, now, percent).select("a", "b").distinct().join(best, ["a", "b"], "left_anti"))
    last = cut(_confirmed(rest, sets, percent))
    all_roots = components(joined.unionByName(last)).withColumnRenamed("node", "key")
    drop(classes, met, sets, counted, best, more, rest, last, roots, now)
    return _with_components(rows, all_roots)


def _with_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = rows.where("key is not null").groupBy("key").agg(F.min("doc").alias("first"))
    joined = known.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    to = joined.join(smallest, "root").select("key", "component_id")
    full = rows.where("key is not null").join(to, "key").select("doc", "n", "component_id")
    bare = rows.where("key is null").select("doc", "n", F.col("doc").alias("component_id"))
    return full.unionByName(bare).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("doc").eqNullSafe(F.col("component_id")).alias("kept"))
