"""A trigram index that is kept up by batches of changes and read by the partitions of a term alone.

An index is a folder. `postings` holds (gram, batch, ids), partitioned by bucket, a
hash of the gram, and by batch; `changed` holds (id, batch): a posting counts if no
later batch changed its row. Nothing is rewritten: a batch adds its own partitions, and
if it is run again replaces them. Compaction writes the postings that count to a new
folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import TOKEN_CHARS, contains

#: Partitions of the postings: a term of ten characters reads eight of them at most.
BUCKETS = 64
#: Characters of texts whose postings are sorted at once, and changed ids up to which they are broadcast; beyond it the join shuffles.
SLICE, BROADCAST_IDS = 2_000_000, 500_000


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _listed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (key, row) in order of row: the distinct keys, where the rows of each begin and the last end, and the rows, each once for a key."""
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    other = np.ones(len(keys), bool)
    other[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    keys, rows = keys[other], rows[other]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[starts], np.append(starts, len(keys)), rows


def _batch(made: list[str], ends: np.ndarray, ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(rows)))], ["gram", "ids"])


def _lists_of_texts(texts: DataFrame, id_type: str) -> DataFrame:
    """(gram, ids) of texts (id, text in lower case): some SLICE characters at a time, what they hold of a gram as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            begin, size = 0, 0
            for end, text in enumerate(all_texts, 1):
                size += len(text or "")
                if size < SLICE and end < len(all_texts):
                    continue
                some = [t or "" for t in all_texts[begin:end]]
                codes = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
                row = np.repeat(np.arange(begin, end), [len(t) for t in some])
                begin, size = end, 0
                if len(codes) < 3:
                    continue
                whole = row[:-2] == row[2:]
                keys = ((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])[whole]
                keys, ends, held = _listed(keys, row[:-2][whole])
                mask = np.uint64((1 << 21) - 1)
                joined = np.stack([keys >> np.uint64(42), (keys >> np.uint64(21)) & mask, keys & mask], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                yield _batch([joined[i : i + 3] for i in range(0, len(joined), 3)], ends, batch.column(0), held)

    return texts.mapInArrow(run, f"gram string, ids array<{id_type}>")


def _lists_of_pairs(pairs: DataFrame, id_type: str) -> DataFrame:
    """(gram, ids) of postings (id, gram): what an Arrow batch holds of a gram as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            keys, ends, held = _listed(coded.indices.to_numpy(zero_copy_only=False), np.arange(batch.num_rows))
            yield _batch(coded.dictionary.take(pa.array(keys)).to_pylist(), ends, batch.column(0), held)

    return pairs.mapInArrow(run, f"gram string, ids array<{id_type}>")


def _write(lists: DataFrame, batch: int, folder: str) -> None:
    """Posting lists by gram: (bucket, batch, gram, ids); a gram has a list of each part of the rows. A bucket is written by as many tasks as its size asks for."""
    dealt = lists.select(_bucket(F.col("gram")).alias("bucket"), F.lit(batch).alias("batch"), "gram", "ids").hint("rebalance", "bucket")
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{folder}/postings")


def apply_batch(folder: str, batch: int, changes: DataFrame, key: str = "id", text: str = "content") -> None:
    """Takes changes (key, op, message_type, text) into the index: op is insert, update or delete. Only prompts are indexed.

    Every changed row is marked, so what earlier batches say of it no longer counts;
    rows that are prompts now get new postings. A row changes once in a batch.
    """
    rows = changes.select(F.col(key).alias("id"), "op", "message_type", F.col(text).alias("text"))
    rows.filter("op != 'insert'").select("id", F.lit(batch).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/changed")
    shown = rows.filter("op != 'delete' AND message_type = 'prompt'")
    _write(_lists_of_texts(shown.select("id", F.lower("text").alias("text")), dict(rows.dtypes)["id"]), batch, folder)


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _postings(spark: SparkSession, folder: str, id_type: str) -> DataFrame:
    return _read(spark, folder, "postings", f"gram string, ids array<{id_type}>, bucket int, batch int")


def _counting(postings: DataFrame, folder: str, id_type: str) -> DataFrame:
    """Of rows (id, batch, ...) those that no later batch has changed."""
    last = _read(postings.sparkSession, folder, "changed", f"id {id_type}, batch int").groupBy("id").agg(F.max("batch").alias("changed"))
    last = F.broadcast(last) if last.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else last
    return postings.join(last, "id", "left").filter("changed IS NULL OR changed <= batch").drop("changed")


def compact(spark: SparkSession, folder: str, into: str, id_type: str = "long") -> str:
    """The index with only the postings that count, in the new folder `into`, as its batch 0."""
    rows = _postings(spark, folder, id_type).select("gram", "batch", F.explode("ids").alias("id"))
    _write(_lists_of_pairs(_counting(rows, folder, id_type).select("id", "gram"), id_type), 0, into)
    return into


def candidates(spark: SparkSession, folder: str, words: list[str], id_type: str = "long") -> DataFrame:
    """(id) of the rows that hold all trigrams of the words, each of three characters or more.

    Reads the partitions of these trigrams. The rarest one's rows are the candidates; of
    the others' lists only what meets them is counted.
    """
    wanted = sorted({w.lower()[i : i + 3] for w in words for i in range(len(w) - 2)})
    made = spark.createDataFrame([(g,) for g in wanted], "gram string")
    buckets = [r[0] for r in made.select(_bucket(F.col("gram"))).distinct().collect()]  # of one term
    lists = _postings(spark, folder, id_type).filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    sizes = {r["gram"]: r["n"] for r in lists.groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}
    if len(sizes) < len(wanted):
        return spark.createDataFrame([], f"id {id_type}")
    rarest = min(wanted, key=lambda g: (sizes[g], g))
    rows = lists.select("gram", "batch", F.explode("ids").alias("id"))
    start = _counting(rows.filter(F.col("gram") == rarest), folder, id_type).select("id", "batch").distinct()
    full = rows.join(start, ["id", "batch"], "left_semi").groupBy("id", "batch").agg(F.countDistinct("gram").alias("n")).filter(F.col("n") == len(wanted))
    return full.select("id").distinct()


def search(folder: str, rows: DataFrame, term: str, mode: str = "phrase", key: str = "id", text: str = "content") -> DataFrame:
    """The prompts among rows that hold the term as `search.contains` says; terms without a word of three characters are looked for in all of them."""
    prompts = rows.filter("message_type = 'prompt'")
    words = [w for w in term.split() if len(w) >= TOKEN_CHARS] if mode == "all_tokens" else [term.strip()] if len(term.strip()) >= TOKEN_CHARS else []
    if words:
        found = candidates(rows.sparkSession, folder, words, dict(rows.dtypes)[key])
        prompts = prompts.join(found.withColumnRenamed("id", key), key, "left_semi")
    return prompts.filter(contains([F.col(text)], term, mode))
