"""Tables cut from their lineage in the folder that all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Where that is unset, a
    temporary one is set for the session if all of it runs on this machine; on a
    cluster, whose executors would not see such a folder, it is an error."""
    conf = spark.sparkContext.getConf()
    place = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="cuesmith-")
        spark.conf.set("spark.checkpoint.dir", place)
    return "/".join([place.rstrip("/"), *_WITHIN])


_WITHIN: list[str] = []


@contextlib.contextmanager
def tables_within(folder: str) -> Iterator[None]:
    """Until the end, tables are cut to this folder of the shared one, so that its
    owner can remove it with all that others left in it."""
    _WITHIN.append(folder)
    try:
        yield
    finally:
        _WITHIN.pop()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later stages
    restart from files and not from a lost executor's blocks."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut made, once what was made from them has been cut too."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove(df.sparkSession, file.rpartition("/")[0])


def parts(spark: SparkSession) -> int:
    """The cluster's number of shuffle partitions, set to suit the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_KEPT: dict[str, Callable[[], None]] = {}


def keep(owner: str, forget: Callable[[], None]) -> None:
    """Say how to forget what an operator remembers in a Python worker between its tasks."""
    _KEPT[owner] = forget


def take_over(owner: str) -> None:
    """At a task's start: what other operators remember in this worker is forgotten,
    as their words would stand beside this one's tables for as long as it lives."""
    for name, forget in _KEPT.items():
        if name != owner:
            forget()
    give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live on and
    serve later stages, beside a JVM that has grown by then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its memory
