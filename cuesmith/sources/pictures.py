"""Average hashes of image files, read by Spark's image source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _weights(size: int, cells: int) -> np.ndarray:
    """cells x size: how much of each pixel lies in each cell, as a part of the cell."""
    edges = np.arange(cells + 1) * size / cells
    low, high = np.maximum(edges[:-1, None], np.arange(size)[None, :]), np.minimum(edges[1:, None], np.arange(1, size + 1)[None, :])
    part = np.maximum(0.0, high - low)
    return part / part.sum(1, keepdims=True)


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey values of rows of blue, green, red (and alpha), or of grey ones."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return pixels[:, :, 0]
    return (pixels[:, :, 2] * 299 + pixels[:, :, 1] * 587 + pixels[:, :, 0] * 114) / 1000


def average_hash(data: bytes, height: int, width: int, channels: int, side: int = 16) -> list[int]:
    """side x side bits, row after row, as 64-bit words: 1 where the mean over the
    cell's area is at or over the mean of all cells."""
    cells = _weights(height, side) @ grey(data, height, width, channels) @ _weights(width, side).T
    bits = (cells >= cells.mean()).astype(np.uint8).ravel()
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def image_hashes(spark: SparkSession, path: str, side: int = 16) -> DataFrame:
    """(path, height, width, words) of the images at path; words is null for a file
    that is no image (side * side is a multiple of 64)."""
    read = spark.read.format("image").option("dropInvalid", "false").load(path).selectExpr("image.origin AS path", "image.height AS height", "image.width AS width", "image.nChannels AS channels", "image.data AS data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(k).to_pylist() for k in range(1, 4)], batch.column(4), strict=True)
            words = [average_hash(d.as_py(), h, w, c, side) if h > 0 and w > 0 else None for h, w, c, d in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.list_(pa.int64()))], ["path", "height", "width", "words"])

    return read.mapInArrow(run, "path string, height int, width int, words array<long>")
