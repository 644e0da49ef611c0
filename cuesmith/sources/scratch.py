"""A place for files that a query writes and reads again, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``; where that is unset, in a
    temporary folder, which only a session on one machine may use."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="cuesmith-")
    return f"{place.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to a fresh folder and read again: what follows starts
    from files, whatever executors are lost."""
    place = fresh_folder(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut made, once nothing reads them any more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
