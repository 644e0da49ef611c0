"""Exact nearest neighbours by a block matrix join of int8 tiles.

Queries and candidates are dealt to blocks; a tile is one block of each.  In a
tile, vectors are scaled to int8, one matrix product gives all dot products, and
the rounding errors' norms bound each distance from both sides.  Only pairs whose
lower bound does not exceed the query's k-th smallest upper bound are computed
again in double precision; each tile keeps a query's k nearest in a heap, and the
tiles' heaps are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts

#: Queries and candidates of one tile, at most about.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 65536
#: Queries and candidates of one product within a tile.
BAND, STRIP = 512, 4096


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of the rounding errors, norms of the rounded vectors."""
    scale = np.maximum(np.abs(x).max(1) / 127, np.finfo(float).tiny)
    rounded = np.rint(x / scale[:, None])
    wide = rounded * scale[:, None]
    return rounded.astype(np.int8), scale, np.linalg.norm(x - wide, axis=1), np.linalg.norm(wide, axis=1)


def _without_surplus(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only the k + 1 smallest ids can be among a query's k nearest
    (one may be the query's own, and ties go to smaller ids)."""
    if len(ids) <= k + 1:
        return ids, x
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    starts = np.concatenate(([True], same[order][1:] != same[order][:-1]))
    nth = np.arange(len(order)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    kept = np.sort(order[nth <= k])
    return ids[kept], x[kept]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = q - c
    total = np.zeros(len(gap))
    for d in range(gap.shape[1]):  # in the order of dimensions, so that any engine's plain sum is the same
        total += gap[:, d] * gap[:, d]
    return np.sqrt(total)


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, distance) of each query's k nearest of one tile."""
    c = c + 0.0  # -0.0 is 0.0
    c_ids, c = _without_surplus(c_ids, c, k)
    # Sums of int8 products are whole numbers; float32 holds them exactly up to 2**24, that is 1040 dimensions.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    q8, qs, qe, qn = _quantised(q)
    q_sq = (q * q).sum(1)
    for at in range(0, len(c), STRIP):
        ids, own = c_ids[at : at + STRIP], c[at : at + STRIP]
        c8, cs, ce, cn = _quantised(own)
        c8, c_sq = c8.astype(kind).T, (own * own).sum(1)
        for top in range(0, len(q), BAND):
            band = slice(top, top + BAND)
            about = (q8[band].astype(kind) @ c8).astype(np.float64)
            about *= qs[band, None] * cs[None, :]
            about *= -2
            sums = q_sq[band, None] + c_sq[None, :]
            about += sums
            slack = (2 * (qn[band] + qe[band]))[:, None] * ce[None, :] + (2 * qe[band])[:, None] * cn[None, :]
            slack += 1e-9 * sums
            same = q_ids[band, None] == ids[None, :]
            most = np.where(same, np.inf, about + slack)
            limit = np.partition(most, k - 1, axis=1)[:, k - 1] if most.shape[1] > k else np.full(len(most), np.inf)
            worst = np.array([-h[0][0] if len(h) == k else np.inf for h in heaps[band]])
            limit = np.minimum(limit, worst * worst * (1 + 1e-9))
            i, j = np.nonzero((about - slack <= limit[:, None]) & ~same)
            for part in range(0, len(i), 1 << 16):
                rows, cols = i[part : part + (1 << 16)] + top, j[part : part + (1 << 16)]
                for row, distance, other in zip(rows.tolist(), _exact(q[rows], own[cols]).tolist(), ids[cols].tolist(), strict=True):
                    heap, entry = heaps[row], (-distance, -other)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
    return [(int(i), -j, -distance) for i, heap in zip(q_ids, heaps, strict=True) for distance, j in heap]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]).astype(np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each query, nearest
    first, ties to the smaller vec_id; queries are the rows whose id is divisible
    by ``every``, candidates all rows but those of the query's own id.

    Null or zero vectors, those with null or non-finite components, and rows of
    null id take no part.  Distances are only between vectors of equal length.
    Rows repeated with one id and vector count once; two vectors of one id are
    two candidates.  An empty table gives an empty result; other columns are
    ignored.

    A tile has at most about QUERY_BLOCK queries and CANDIDATE_BLOCK candidates;
    there are as many tiles as the two counts ask for, and at least one for each
    shuffle partition.
    """
    spark = vectors.sparkSession
    good = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        .where("id is not null and v is not null and size(v) > 0")
        .where(F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0))
        .distinct()
        .withColumn("dim", F.size("v"))
    )
    queries = good.where(F.pmod("id", F.lit(every)) == 0)
    counts = good.select(F.count("*"), F.count_if(F.pmod("id", F.lit(every)) == 0)).first()
    blocks = max(1, -(-counts[1] // QUERY_BLOCK))
    strips = max(1, -(-counts[0] // CANDIDATE_BLOCK), -(-parts(spark) // blocks))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = queries.withColumn("qb", deal(blocks, 1)).withColumn("cb", each(strips))
    right = good.withColumn("cb", deal(strips, 2)).withColumn("qb", each(blocks))
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def tile(q: pa.Table, c: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if len(q) and len(c):
            dim = q.column("dim")[0].as_py()
            rows = tile_nearest(q.column("id").to_numpy(), _matrix(q.column("v"), dim), c.column("id").to_numpy(), _matrix(c.column("v"), dim), k)
        return pa.table([list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []], schema=kinds)

    keys = ["dim", "qb", "cb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
