"""Worksheets as rows: a Python data source and a loader over many files.

A workbook is bounded (an upload's limits), so one file is one task's; many files
are spread over tasks.  ``read_workbooks`` takes any path that Spark reads.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.normal import row_verdict
from ..functions.text import preview

# Limits of an accepted workbook.
MOST_BYTES, MOST_ENTRIES = 20 << 20, 100
MOST_UNPACKED, MOST_UNPACKED_EACH = 200 << 20, 64 << 20
KIND = "row_number int, col string, value string"
#: Cells of one batch that a task gives back.
ROWS = 4096


def guard(data: bytes, most_bytes: int = MOST_BYTES) -> zipfile.ZipFile:
    """The opened archive; raises ValueError for what isn't one or is over a limit."""
    if len(data) > most_bytes:
        raise ValueError(f"workbook of {len(data)} bytes is over {most_bytes}")
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ValueError("not a workbook") from e
    sizes = [i.file_size for i in archive.infolist()]
    if len(sizes) > MOST_ENTRIES or sum(sizes) > MOST_UNPACKED or max(sizes, default=0) > MOST_UNPACKED_EACH:
        raise ValueError("workbook unpacks to more than the limits")
    return archive


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter() if t.tag.endswith("}t"))


def cells(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(row, column letters, text) of the non-empty cells of the lowest-numbered sheet."""
    with guard(data) as archive:
        names = {int(m[1]): n for n in archive.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n))}
        if not names:
            raise ValueError("a workbook without sheets")
        shared = []
        if "xl/sharedStrings.xml" in archive.namelist():
            shared = [_texts(si) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if si.tag.endswith("}si")]
        sheet = ElementTree.fromstring(archive.read(names[min(names)]))
    for cell in sheet.iter():
        place = re.fullmatch(r"([A-Z]{1,3})(\d+)", cell.get("r") or "") if cell.tag.endswith("}c") else None
        if place is None:
            continue
        kind = cell.get("t")
        raw = next((v.text or "" for v in cell if v.tag.endswith("}v")), "")
        if kind == "inlineStr":
            text = _texts(cell)
        elif kind == "s":
            text = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
        else:
            text = raw
        if text.strip():
            yield int(place[2]), place[1], text.strip()


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").option("path", ...)``: cells of local files,
    a partition for each."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, " + KIND

    def reader(self, schema) -> DataSourceReader:
        return _WorkbookReader(self.options)


class _WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read(MOST_BYTES + 1)
        for row in cells(data):
            yield (partition.value, *row)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_number, col, value, error): cells of all workbooks under path; a
    file that can't be read is one row with its error."""
    return parse_workbooks(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path))


def parse_workbooks(files: DataFrame) -> DataFrame:
    """As read_workbooks, of files that are rows (path, content)."""

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "row_number", "col", "value", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    own = [(name.as_py(), *c, None) for c in cells(data.as_py())]
                except (ValueError, ElementTree.ParseError) as e:
                    own = [(name.as_py(), None, None, None, str(e))]
                rows += own
                if len(rows) >= ROWS:  # many small files make one batch
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path", "content").mapInArrow(run, f"path string, {KIND}, error string")


def task_rows(cells_: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(path, row_number, video_path, text, verdict, text_preview): rows from the
    second on that have A or B.  files: a listing whose column ``file`` tells what exists."""
    by = cells_.where("row_number >= 2 AND col IN ('A', 'B')").groupBy("path", "row_number")
    rows = by.agg(F.max(F.when(F.col("col") == "A", F.col("value"))).alias("video_path"), F.max(F.when(F.col("col") == "B", F.col("value"))).alias("text"))
    exists = None
    if files is not None:
        rows = rows.join(files.select(F.col("file").alias("video_path"), F.lit(True).alias("_there")).distinct(), "video_path", "left")
        exists = F.coalesce("_there", F.lit(False))
    return rows.select("path", "row_number", "video_path", "text", row_verdict(F.col("video_path"), F.col("text"), exists).alias("verdict"), preview(F.coalesce("text", F.lit(""))).alias("text_preview"))


def column(cells_: DataFrame, letters: str) -> DataFrame:
    return cells_.where(F.col("col") == letters).select("path", "row_number", "value").orderBy("path", "row_number")
