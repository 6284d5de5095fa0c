"""Audit of how filters interact: every order of five filters, run as a trie of survivor tables."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import checkpoint_dir, cut, small_side
from .kernels import release

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
#: Bytes of a text that are split into words at once.
PIECE = 4_000_000
#: A group of equal texts with this part of all rows is hot: there are at most so many, they are broadcast, and their rows stay where they are.
HOT = 1000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_UPPER, _MARKS = bytes(range(0x41, 0x5B)), b"#$%&*|"


def word_counts(text: bytes, piece: int = PIECE) -> tuple[int, int]:
    """Words and distinct words; a long text is split piece by piece, so only its distinct words are held."""
    if len(text) <= piece:
        words = text.split()
        return len(words), len(set(words))
    n, seen, start = 0, set(), 0
    while start < len(text):
        found = _SPACE.search(text, start + piece)
        end = found.start() if found else len(text)
        words = text[start:end].split()
        n += len(words)
        seen.update(words)
        start = end
    return n, len(seen)


def failed_filters(text: bytes, code_points: int) -> int:
    """Bits of the filters A to D that a text fails; E needs the whole table."""
    words, distinct = word_counts(text)
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (words < 200, 100 * distinct < 50 * words, 100 * upper > 3 * code_points, len(text.translate(None, _MARKS)) < len(text))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, text) to (doc_id, part, mask, digest)."""
    for batch in batches:
        column = batch.column(2)
        lengths = pc.utf8_length(column).to_pylist()
        raw = column.cast(pa.binary())
        masks, digests = [], []
        for a, text in enumerate(raw):
            b = text.as_py()
            masks.append(failed_filters(b, lengths[a]))
            digests.append(hashlib.sha256(b).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])
    release()


def filter_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for each row of docs: the filters that its text fails, as bits in the order of FILTERS.

    Texts are read once. Equal texts are found by SHA-256 over the whole table: counts
    and least ids by digest are aggregated first, only digests that recur are joined
    back, and the few with a thousandth of all rows are broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    read = cut(rows.mapInArrow(_read, "doc_id long, part string, mask int, digest binary"))
    groups = cut(read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT >= total
    hot, rest = F.broadcast(groups.filter(is_hot).select("digest", F.col("first").alias("hot_first"))), groups.filter(~is_hot).select("digest", "first")
    found = read.join(hot, "digest", "left").join(small_side(rest), "digest", "left")
    first = F.coalesce("hot_first", "first")
    again = F.when(F.col("doc_id") > first, 1 << FILTERS.index("E")).otherwise(0)
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask"))


def _labelled(masks: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """masks with the flags good and toxic; rows without an id have no labels and stay out of the join."""
    flags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    flags = flags.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = masks.filter("doc_id IS NOT NULL").join(flags, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return joined.union(masks.filter("doc_id IS NULL").select("part", "mask", F.lit(False), F.lit(False)))


def _fails(k: int) -> Column:
    return F.col("mask").bitwiseAND(1 << k) != 0


def run_trie(rows: DataFrame) -> DataFrame:
    """(part, state, before, removed, good, toxic): what each filter removes from the survivors of each set of filters.

    rows: (part, mask, good, toxic). The trie of all orders is walked depth first. A
    node's survivors are its parent's less the rows that fail the filter of the edge,
    persisted while its subtree is walked. Orders of the same filters lead to the same
    survivors, so a set of filters is walked once: 31 tables instead of 326 nodes.
    removed, good and toxic are arrays over FILTERS, counted on those survivors;
    filters already applied count 0. Each node's counts are written at once, so a
    table is let go as soon as its subtree is done; if an executor is lost, its part
    is filtered anew from the parent's.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/trie-{uuid.uuid4().hex}"
    walked: set[int] = set()

    def count(state: int, survivors: DataFrame) -> None:
        def over(*conditions: Column) -> Column:
            sums = []
            for k in range(len(FILTERS)):
                all_of = _fails(k)
                for c in conditions:
                    all_of = all_of & c
                sums.append(F.lit(0).cast("long") if state >> k & 1 else F.count_if(all_of))
            return F.array(*sums)

        counts = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("before"), over().alias("removed"), over(F.col("good")).alias("good"), over(F.col("toxic")).alias("toxic"))
        counts.withColumn("state", F.lit(state)).write.mode("append").parquet(folder)

    def walk(state: int, survivors: DataFrame) -> None:
        walked.add(state)
        survivors.persist()
        try:
            count(state, survivors)
            for k in range(len(FILTERS)):
                after = state | 1 << k
                if after not in walked and after != ALL:
                    walk(after, survivors.filter(~_fails(k)))
        finally:
            survivors.unpersist()

    walk(0, rows)
    return spark.read.schema("part string, before long, removed array<long>, good array<long>, toxic array<long>, state int").parquet(folder)


def orders() -> list[dict]:
    """Every step of every order: filter_order, step, its filter's place k, and the set of filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        state = 0
        for step, k in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "k": k, "state": state})
            state |= 1 << k
    return out


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    A filter's removals are counted on the survivors of the filters before it
    (run_trie), never reckoned from flags. What it would remove alone is its count at
    the root, what only it removes is its count after all others, and a set of s
    filters comes before it in s! (4 - s)! orders, which weights the sums.

    Edge cases: a null text is empty, and empty texts equal each other; a null part is
    the part ''; a row without doc_id is no copy (E) and has no labels; repeated rows
    of one doc_id count each, and aren't copies of one another, as E asks for a
    smaller doc_id; of repeated labels of a doc_id one with the value 1 suffices. A
    text of any length is read whole, in pieces. Tables without rows give no rows, and
    further columns, whatever their names, are ignored.
    """
    rows = cut(_labelled(filter_masks(docs, id_col, text_col, part_col), labels, "doc_id"))
    trie = run_trie(rows)
    edges = trie.select("part", "state", "before", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("k", "n")).select("part", "state", "before", "k", "n.*")
    edges = cut(edges.filter(F.expr("(state >> k) & 1 = 0")))

    size = F.bit_count("state")
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(len(FILTERS) - 1 - s)) for s in range(len(FILTERS))]), (size + 1).cast("int"))
    alone, last = F.col("state") == 0, size == len(FILTERS) - 1
    by_filter = edges.groupBy("part", "k").agg(
        F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.when(alone, F.col("removed")).otherwise(0)).alias("fails"), F.sum(F.when(last, F.col("removed")).otherwise(0)).alias("unique_fails")
    )
    steps = F.explode(F.from_json(F.lit(json.dumps(orders())), "array<struct<filter_order:string,step:int,k:int,state:int>>"))
    grid = by_filter.select("part").distinct().select("part", steps.alias("s")).select("part", "s.*")
    out = grid.join(by_filter, ["part", "k"]).join(edges, ["part", "k", "state"], "left").na.fill(0, ["before", "removed", "good", "toxic"])
    removed = F.col("removed")
    return out.select(
        "part", "filter_order", "step", (F.col("before") - removed).alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
