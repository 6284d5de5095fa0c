"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import ascii_lower, cut, small_side

#: Characters that the second refinement hashes.
PREFIX = 256
#: A group with this part of all rows is hot: there are at most so many, they are broadcast, and their rows stay where they are.
HOT = 1000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) for each row of docs; see refine."""
    return refine(docs, id_col, text_col, digest).drop("print")


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256, print) for each row of docs; print is a hash of its text as it is.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Rows are refined in three scans: all by length; those whose length recurs by
    a hash of their prefix too; those whose (length, prefix hash) recurs by SHA-256
    of the whole text. Other rows are alone and their full text is never hashed,
    unless `digest` asks for everybody's SHA-256. Only counts of distinct keys are
    shuffled, so a group with a third of all rows costs no more than a small one.
    The few recurring keys are broadcast behind a check of their number; beyond it
    the joins shuffle.

    Edge cases: null and empty texts form one group; rows of one doc_id are told
    apart by text, and equal rows of one doc_id count each in group_size and all
    report the same verdict; a null doc_id never stays if another row of its group
    has one; other columns of docs are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("n", F.octet_length(F.coalesce("t", F.lit(""))))
    head = F.xxhash64(ascii_lower(F.substring("t", 1, PREFIX)))

    lengths = cut(rows.groupBy("n").count().filter("count > 1").select("n"))
    heads = rows.join(small_side(lengths), "n", "left_semi").select("n", head.alias("head"))
    heads = cut(heads.groupBy("n", "head").count().filter("count > 1").select("n", "head", F.lit(True).alias("again")))

    found = rows.withColumn("head", head).join(small_side(heads), ["n", "head"], "left")
    again, full = F.coalesce("again", F.lit(False)), F.sha2(ascii_lower(F.col("t")), 256)
    found = cut(found.select("doc_id", F.xxhash64("t").alias("print"), again.alias("again"), (full if digest else F.when(again, full)).alias("text_sha256")))

    again = found.filter("again")
    groups = cut(again.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.broadcast(groups.filter(F.col("group_size") * HOT >= total))
    rest = again.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(groups.filter(F.col("group_size") * HOT < total), "text_sha256")
    met = again.join(hot, "text_sha256").unionByName(rest)
    alone = found.filter("not again").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    out = ["doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256", "print"]
    return met.select(out).union(alone.select(out))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text is not also that of a row with a larger doc_id; rows of one id, or none, are told apart by their texts."""
    gone = refine(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("print").alias("__print"))
    same = docs[id_col].eqNullSafe(F.col("__gone")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__print"))
    return docs.join(cut(gone.distinct()), same, "left_anti")
