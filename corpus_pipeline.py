"""The corpus pipeline: each stage works on all that the one before it kept.

Every stage but the last returns the columns of documents, whatever they are, and
takes repeated rows, null values in any column and empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesmith.llm import jaccard, language, packing, quality, secret_scan
from cuesmith.llm.shared import cut, drop, remove, shared_folder, tables_within

#: A document is rejected by language ID if its language is unsure below this, or undetermined.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a language learned from docs, with LEAST_SCORE or more.

    Rejected: null and empty texts, texts without a letter, and all rows if none
    has both a language and a text.  Null ids and sources play no part; a null
    language is not learned from.  Repeated rows stay or go together; of equal
    scores the first language in order counts.  An empty table stays empty.
    """
    return language.keep_identified(docs, language.fit(docs), LEAST_SCORE)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the quality rules, by the fences of their language and source.

    Rejected: null, empty and very short texts.  A null language or source is a
    group of its own; repeated rows stay or go together; a value on its fence
    stays.  An empty table stays empty.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of near duplicates.

    Of equal rows of one id, one stays; unlike rows of one id both stay, if it is
    the smallest of its component.  A null id is never the smallest beside others;
    among null ids alone all unlike texts stay.  A null or empty text is near
    nothing and stays.  An empty table stays empty.
    """
    found = jaccard.jaccard_components(docs)
    kept = found.where("doc_id <=> component_id").select(F.struct("doc_id").alias("_id")).distinct()
    # Keyed by a struct, which equals itself when the id is null: one exchange serves the join and the copies.
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("_id"), F.xxhash64("text").alias("_text"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    return rows.join(kept, "_id", "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with each secret in the text masked and n_chars counted anew.

    A null text stays null, with a null count; an empty one stays empty.  Repeated
    rows are masked alike; a null source is an empty path.  An empty table stays
    empty.
    """
    masked = secret_scan.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row: its place in a sequence of 4096 tokens.

    A null or empty text is its end token alone; repeated rows are packed each on
    its own; equal lengths take places by id and piece, null ids first.  An empty
    table gives an empty result.
    """
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Language ID, sketches and packing have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on documents, each written as Parquet and read again.  A
    stage's tables in between stand in a folder of its own within the shared one,
    which is deleted when its result has been written; so is that, when the next
    stage's has.  What the last stage's result reads stays."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        own = f"{name}-{uuid.uuid4().hex}"
        with tables_within(own):
            result = stage(spark, docs, sf_dir)
        docs = cut(result)
        remove(spark, f"{shared_folder(spark)}/{own}")
        drop(*made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
