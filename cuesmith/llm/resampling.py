"""Importance resampling towards a target distribution.

DuckDB runs in each task over slices of a partition: SQL unnests a text's words,
windows them to n-grams and counts them by bucket, where a registered function
gives zlib's CRC.  Each text's bucket counts are spilled to Parquet in the shared
folder; Spark merges them to the table's counts, turns these and the target's into
gains, scores every text and draws the highest scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, give_back, parts, take_over
from .shingles import slices, text_buffer

BUCKETS = 10_000
#: Bytes of text that DuckDB gets at a time, and what it may take for them.
SLICE_BYTES, MEMORY = 2 << 20, "400MB"
#: Words of texts in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Texts of at least so many words can be drawn, and so many hundredths of them are.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: The last words of a stretch of text, as many as asked for.
_TAIL = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _bucket(grams: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) % BUCKETS for g in grams.to_pylist()], pa.int32())


def _session() -> duckdb.DuckDBPyConnection:
    """An engine in memory that leaves no files and keeps to its task's core."""
    con = duckdb.connect()
    con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = ''; SET preserve_insertion_order = true")
    con.create_function("bucket", _bucket, [duckdb.sqltypes.VARCHAR], duckdb.sqltypes.INTEGER, type="arrow")
    return con


def _counts_sql(order: int) -> str:
    """Bucket counts of each row of ``slice`` (row, carried, text), where the first
    ``carried`` words of a text belong to the stretch before it."""
    grams = []
    for k in range(1, order + 1):
        before = [f"lag(w, {j}) OVER p" for j in range(k - 1, 0, -1)]
        window = " WINDOW p AS (PARTITION BY row, piece ORDER BY i) QUALIFY " + before[0] + " IS NOT NULL AND i > carried" if before else " WHERE i > carried"
        grams.append(f"SELECT row, concat_ws(' ', {', '.join([*before, 'w'])}) AS g FROM words{window}")
    return f"""
    WITH found AS (SELECT row, piece, carried, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM slice
    ), words AS (SELECT row, piece, carried, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM found
    ), grams AS ({" UNION ALL ".join(grams)}
    ), each AS (SELECT row, g, count(*) AS c FROM grams GROUP BY row, g
    ), buckets AS (SELECT g, bucket(g) AS b FROM (SELECT DISTINCT g FROM each)
    ), counted AS (SELECT row, b, CAST(sum(c) AS BIGINT) AS c FROM each JOIN buckets USING (g) GROUP BY row, b
    ), sizes AS (SELECT row, CAST(sum(len(ws) - carried) AS BIGINT) AS n FROM found GROUP BY row)
    SELECT sizes.row, any_value(n) AS n, list(b ORDER BY b) FILTER (b IS NOT NULL) AS b, list(c ORDER BY b) FILTER (b IS NOT NULL) AS c
    FROM sizes LEFT JOIN counted ON counted.row = sizes.row GROUP BY sizes.row ORDER BY sizes.row
    """


def _stretches(text: bytes, order: int) -> Iterator[tuple[int, bytes]]:
    """A long text cut where no word goes on, each stretch with the order - 1 words before it."""
    data, at, carry = np.frombuffer(text, np.uint8), 0, []
    while at < len(text):
        to = min(len(text), at + SLICE_BYTES)
        while to < len(text) and not _BREAK[data[to]]:
            gap = np.flatnonzero(_BREAK[data[to : to + SLICE_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(len(text), to + SLICE_BYTES)
        yield len(carry), b" ".join([*carry, text[at:to]])
        if order > 1:
            carry = [*carry, *_TAIL.findall(text[at:to])][1 - order :]
        at = to


def _tables(column: pa.Array, order: int) -> Iterator[pa.Table]:
    """Tables of rows (row, piece, carried, text): whole texts together, a long text's stretches one by one."""
    data, offsets = text_buffer(column)
    sizes = np.diff(offsets)
    short = np.flatnonzero(sizes <= SLICE_BYTES)
    if len(short):
        zero = np.zeros(len(short), np.int32)
        yield pa.table({"row": pa.array(short, pa.int32()), "piece": zero, "carried": zero, "text": column.take(pa.array(short)).fill_null("")})
    for row in np.flatnonzero(sizes > SLICE_BYTES).tolist():
        text = data[offsets[row] : offsets[row + 1]].tobytes()
        for piece, (carried, part) in enumerate(_stretches(text, order)):
            yield pa.table({"row": pa.array([row], pa.int32()), "piece": pa.array([piece], pa.int32()), "carried": pa.array([carried], pa.int32()), "text": [part.decode()]})


def bucket_counts(texts: DataFrame, id_col: str, text_col: str = "text", order: int = 1) -> DataFrame:
    """(id, n_words, n_features, buckets, counts): each text's n-grams of 1 to
    ``order`` words by bucket, with repeats.  A null text has none."""
    sql = _counts_sql(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("resampling")
        con = _session()
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            n, found = np.zeros(batch.num_rows, np.int64), {}
            for table in _tables(batch.column(1), order):
                con.register("slice", table)
                out = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("slice")
                for row, words, b, c in zip(*[out.column(k).to_pylist() if k < 2 else out.column(k) for k in range(4)], strict=True):
                    n[row] += words
                    if b.is_valid:
                        own = (b.values.to_numpy(), c.values.to_numpy())
                        if row in found:  # a further stretch of a long text
                            both = np.concatenate((found[row][0], own[0])), np.concatenate((found[row][1], own[1]))
                            kinds, at = np.unique(both[0], return_inverse=True)
                            own = kinds, np.bincount(at, both[1]).astype(np.int64)
                        found[row] = own
            none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
            lists = [found.get(row, none) for row in range(batch.num_rows)]
            ends = np.cumsum([0, *[len(b) for b, _ in lists]]).astype(np.int32)
            column = lambda k, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k] for x in lists]) if lists else [], kind))
            totals = np.array([c.sum() for _, c in lists], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n), pa.array(totals), column(0, pa.int32()), column(1, pa.int64())], ["id", "n_words", "n_features", "buckets", "counts"])
        con.close()
        give_back()

    return texts.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, n_words long, n_features long, buckets array<int>, counts array<long>")


def _merged(counted: DataFrame) -> list[int]:
    """The sum of each bucket over a whole table: at most BUCKETS rows reach the driver."""
    out = [0] * BUCKETS
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p")).groupBy(F.col("p.buckets").alias("b")).agg(F.sum("p.counts").alias("c"))
    for r in pairs.collect():
        out[r["b"]] = r["c"]
    return out


def _gains(raw: list[int], target: list[int]) -> list[int]:
    s, t = sum(raw), sum(target)
    return [math.floor(1000 * math.log((y + 1) * (s + BUCKETS) / ((x + 1) * (t + BUCKETS)))) for x, y in zip(raw, target, strict=True)]


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", order: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank counts
    from 1 over the drawn rows, the highest scores of those with LEAST_WORDS words
    or more, PERCENT hundredths of them, and is null for all others.

    A null or empty text has no features and weight 0.  A null id is hashed as an
    empty one and comes last of equal scores.  Repeated rows are scored and drawn
    each on its own; rows equal in score and id take ranks by weight and features.
    With an empty target, gains weigh against what the corpus is full of.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    counted = cut(bucket_counts(docs, id_col, text_col, order))
    gains = _gains(_merged(counted), _merged(bucket_counts(target, target_id, text_col, order)))
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(table, b) * c), F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.greatest(F.col("n_features"), F.lit(1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = counted.withColumn("total", total).select("id", "n_words", "n_features", F.call_function("div", F.col("total") - F.pmod(F.col("total"), n), n).alias("weight"), noise.alias("noise"))
    scored = scored.select("id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))
    drawable = F.col("n_words") >= LEAST_WORDS
    # Rows are sorted by range; a row's rank is its place in its range after the rows of all ranges before.
    order_by = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    sort = scored.where(drawable).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    sort = sort.repartitionByRange(parts(spark), *order_by, "salt").sortWithinPartitions(*order_by, "salt")
    placed = cut(sort.select("id", "n_features", "weight", "score", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = sorted((r["range"], r["c"]) for r in placed.groupBy("range").agg(F.count("*").alias("c")).collect())
    before, sofar = {}, 0
    for key, c in sizes:
        before[key] = sofar
        sofar += c
    drawn = PERCENT * sofar // 100
    starts = F.split(F.lit(",".join(str(before.get(k, 0)) for k in range(max(before, default=0) + 1))), ",").cast("array<long>")
    rank = F.get(starts, F.col("range")) + F.col("place") + 1
    ranked = placed.select("id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    others = cut(scored.where(~drawable).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))
    drop(counted)
    return ranked.unionByName(others).toDF("doc_id", "n_features", "weight", "score", "rank")
