"""A corpus pipeline over the documents table: identify, deduplicate, decontaminate, pack.

Every stage works on all rows that the stage before has kept and is written as
Parquet before the next reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.decontaminate import drop_contaminated
from tallyloom.llm.exact_dedup import drop_exact_copies
from tallyloom.llm.frames import checkpoint_dir, table
from tallyloom.llm.language_id import keep_identified
from tallyloom.llm.near_dedup import drop_near_copies
from tallyloom.llm.packing import pack
from tallyloom.session import ship


#: Documents that a Python worker is sent at once. Workers of all stages live beside one JVM in an executor's memory.
BATCH_DOCUMENTS = 2000


def prepared(spark: SparkSession) -> None:
    """Workers can import this package, and are sent documents in small batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCUMENTS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null and empty texts and texts without a letter go, as nothing can be told of them. Repeated rows are judged alike; extra columns come through; a table
    without rows, or without labelled ones to learn from, gives none. A text of any length is read whole, in segments.
    """
    prepared(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id.

    Texts are equal after lower-casing A-Z; null is an empty text. Of repeated rows of one doc_id and text all stay or all go; a row without doc_id goes if
    another of its text has one.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id: five words, a similarity of 0.8 or more.

    Texts without words have no near-duplicate and stay, and so do rows without doc_id. Rows of one doc_id stay or go together.
    """
    prepared(spark)
    return drop_near_copies(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A document without text holds none and stays, and so does a row without doc_id. Without items all rows stay.
    """
    prepared(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' tokens in sequences of at most 4096.

    A null or empty text is its end token alone. Longer documents are cut, none is dropped; repeated rows are packed each; without rows there are none.
    """
    prepared(spark)
    return pack(docs, capacity=4096)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: SQL can't express the language model, MinHash candidates or the tokenizer; tests hold the deduplication and decontamination stages against brute force, the
#: language model and packing by held-out accuracy and round trips of their operators.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
