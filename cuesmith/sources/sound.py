"""WAV files as a data source that reads byte ranges.

A long recording is many tasks' work: each reads its range of samples and gives
their sums by window; windows that two ranges share are added up afterwards.  Paths
are opened by Arrow's file systems, so on a cluster they may be in any store that
these reach.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of one range, about, and of one task's files; what opening one counts for; rows given back at once.
RANGE_BYTES, OPEN_BYTES, ROWS = 32 << 20, 64 << 10, 4096
#: Decibels of a window of silence.
SILENT = -96.0
COLUMNS = [("path", pa.string()), ("rate", pa.int32()), ("samples", pa.int64()), ("width", pa.int64()), ("win", pa.int64()), ("n", pa.int64()), ("squares", pa.float64()), ("error", pa.string())]


@dataclass(frozen=True)
class Header:
    """Where a file's samples are; frames of one or more channels of 16 bits."""

    rate: int
    channels: int
    start: int
    frames: int


def read_header(file: pa.NativeFile, size: int) -> Header:
    """The header of a RIFF file of 16-bit samples; a data chunk that claims more than the file has ends with it."""
    riff = file.read(12)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    form, at = None, 12
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        elif name == b"data":
            if form is None or form[5] != 16 or form[1] < 1:
                raise ValueError("not 16-bit samples")
            return Header(form[2], form[1], at + 8, min(length, size - at - 8) // (2 * form[1]))
        at += 8 + length + length % 2
    raise ValueError("no samples")


class Pack(InputPartition):
    """What one task reads: spans (path, size, first byte, byte after the last) of files."""

    def __init__(self, spans: list[tuple[str, int, int, int]]):
        self.spans = spans


class WavSource(DataSource):
    """Options: path (a file, or a folder of files ending in .wav), and either seconds
    (a window's length) or windows (how many a file has, the rest at its end left out)."""

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return "path string, rate int, samples long, width long, win long, n long, squares double, error string"

    def reader(self, schema):
        return _WavReader(self.options)


class _WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.seconds, self.windows = options["path"], float(options.get("seconds", 0) or 0), int(options.get("windows", 0) or 0)
        self.most = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def partitions(self) -> list[Pack]:
        """Files by name and size, many small ones or a span of a long one to a task; the tasks read the headers."""
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (pafs.LocalFileSystem(), self.path)
        info = fs.get_file_info(root)
        infos = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.lower().endswith(".wav")]
        out: list[Pack] = []
        spans, cost = [], 0
        for path, size in sorted((x.path, x.size) for x in infos):
            for first in range(0, max(1, size), RANGE_BYTES):
                last = min(size, first + RANGE_BYTES)
                own = OPEN_BYTES * max(1, -(-(last - first) // self.most)) + last - first
                if spans and cost + own > RANGE_BYTES:
                    out.append(Pack(spans))
                    spans, cost = [], 0
                spans.append((path, size, first, last))
                cost += own
        return [*out, Pack(spans)] if spans else out

    def width(self, header: Header) -> int:
        return max(1, header.frames // self.windows) if self.windows else max(1, int(header.rate * self.seconds))

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(COLUMNS)
        fs = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("/") else pafs.LocalFileSystem()
        rows: list[tuple] = []
        for path, size, first, last in partition.spans:
            try:
                file = fs.open_input_file(path)
                h = read_header(file, size)
            except (ValueError, OSError, struct.error) as e:
                if first == 0:
                    rows.append((path, *[None] * (len(COLUMNS) - 2), str(e)))
                continue
            with file:
                for own in self._sums(file, h, first, last):
                    rows += [(path, h.rate, h.frames, self.width(h), *x, None) for x in zip(*own, strict=True)]
                    while len(rows) >= ROWS:
                        yield _batch(rows[:ROWS], schema)
                        rows = rows[ROWS:]
        if rows:
            yield _batch(rows, schema)

    def _sums(self, file: pa.NativeFile, h: Header, first: int, last: int) -> Iterator[tuple[list[int], list[int], list[float]]]:
        """(windows, counts, sums of squares) of the frames that start in the span's
        bytes, a range at a time; a file without samples has a row in its first span."""
        size, width = 2 * h.channels, self.width(h)
        begin, end = (min(h.frames, max(0, -(-(at - h.start) // size))) for at in (first, last))
        if not h.frames and first == 0:
            yield [0], [0], [0.0]
        step = max(1, self.most // size)
        for at in range(begin, end, step):
            file.seek(h.start + at * size)
            pcm = np.frombuffer(file.read((min(end, at + step) - at) * size), "<i2")
            mono = pcm.reshape(-1, h.channels).astype(np.float64).mean(1)
            window = (at + np.arange(len(mono))) // width
            kept = window < self.windows if self.windows else np.ones(len(window), bool)
            own, places = np.unique(window[kept], return_inverse=True)
            yield own.tolist(), np.bincount(places).tolist(), np.bincount(places, mono[kept] ** 2).tolist()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=schema)


def _windows(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(WavSource)
    reader = spark.read.format("wav_windows").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def loudness(spark: SparkSession, path: str, seconds: float = 0.25, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, db): the level of each window of ``seconds``, of the mean of the
    channels, against full scale; SILENT for a window of zeros.  A file that is no
    WAV of 16 bits, or has no samples, gives no rows (``faults`` names the first)."""
    sums = _windows(spark, path, seconds=seconds, rangeBytes=range_bytes).where("error IS NULL").groupBy("path", "win").agg(F.first("rate").alias("rate"), F.first("width").alias("width"), F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    power = F.col("squares") / F.col("n")
    db = F.when(power <= 0, SILENT).otherwise(20 * F.log10(F.sqrt(power) / 32768.0))
    return sums.where("n > 0").select("path", (F.col("win") * F.col("width") / F.col("rate")).alias("at"), db.alias("db"))


def envelopes(spark: SparkSession, path: str, windows: int = 128, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, seconds, envelope): the RMS of so many windows of a file's samples as a
    part of the largest, to six places; windows beyond the samples and files of
    zeros have 0, and a file without samples has an empty envelope."""
    sums = _windows(spark, path, windows=windows, rangeBytes=range_bytes).where("error IS NULL").groupBy("path", "win").agg(F.first("rate").alias("rate"), F.first("samples").alias("samples"), F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    rms = F.when(F.col("n") > 0, F.sqrt(F.col("squares") / F.col("n"))).otherwise(0.0)
    files = sums.withColumn("rms", rms).groupBy("path").agg(F.first("samples").alias("samples"), F.first("rate").alias("rate"), F.max("rms").alias("peak"), F.map_from_entries(F.collect_list(F.struct("win", "rms"))).alias("by"))
    each = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.when(F.col("peak") > 0, F.round(F.coalesce(F.col("by")[k.cast("long")], F.lit(0.0)) / F.col("peak"), 6)).otherwise(0.0))
    return files.select("path", F.round(F.col("samples") / F.col("rate"), 3).alias("seconds"), F.when(F.col("samples") > 0, each).otherwise(F.array().cast("array<double>")).alias("envelope"))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, error) of the files that can't be read."""
    return _windows(spark, path, seconds=1).where("error IS NOT NULL").select("path", "error")


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1) -> bytes:
    """A WAV file of 16-bit samples, channels interleaved."""
    data = np.asarray(samples, "<i2").tobytes()
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    return b"RIFF" + struct.pack("<I", 4 + len(form) + 8 + len(data)) + b"WAVE" + form + struct.pack("<4sI", b"data", len(data)) + data
