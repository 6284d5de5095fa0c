"""Compression of vectors to codes: product quantisation by Lloyd's algorithm in integers, with sums kept by their changes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, small_side
from .kernels import release

#: Components are scaled by this and rounded down.
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Rows whose distances are held at once.
ROWS = 4096


def finite_vectors(vec: Column) -> Column:
    """True for vectors without null or non-finite components; null and empty ones give false."""
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & good, F.lit(False))


def common_length(rows: DataFrame, vec: str) -> int | None:
    """The length that most vectors have, of equally many the shortest; None without rows. Lengths are counted before anything moves."""
    best = rows.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return best["n"] if best else None


def bound(length: int) -> int:
    """Components saturate here, so that a squared distance over `length` of them fits 63 bits: 2**27 for 64 components, which is 131,072 unscaled."""
    return 1 << (62 - max(length - 1, 1).bit_length()) // 2 - 1


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of a list column as integers, one a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of the nearest row of book, ties to the lower, and the squared distance. Exact in integers.

    Products go through floating point only where every sum of them is below 2**53 and so exact.
    """
    codes, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    exact = 4 * max(x.shape[1], 1) * widest * widest < 1 << 53
    norms = (book * book).sum(axis=1)
    for a in range(0, len(x), ROWS):
        some = x[a : a + ROWS]
        if exact:
            d = norms - 2 * (some.astype(np.float64) @ book.T.astype(np.float64)).astype(np.int64)
            d += (some * some).sum(axis=1)[:, None]
        else:
            d = np.stack([((some - entry) ** 2).sum(axis=1) for entry in book], axis=1)
        codes[a : a + ROWS] = d.argmin(axis=1)
        far[a : a + ROWS] = d[np.arange(len(some)), codes[a : a + ROWS]]
    return codes, far


def _assigner(books: np.ndarray, length: int, last: bool):
    """mapInArrow function: the state's rows with their assignment of before and the new one, or with their final code and error."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), length)
            x = np.pad(x, ((0, 0), (0, len(books) * width - length)))
            found = [nearest(x[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            code = [row.tobytes() for row in codes]
            if last:
                error = np.sum([f for _, f in found], axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.hex() for c in code]), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), batch.column("code"), pa.array(code, pa.binary())], ["vec_id", "label", "v", "was", "code"])
        release()

    return run


def _deltas(shape: tuple[int, int, int], length: int):
    """mapInArrow function: what the parts whose assignment changed add to and take from the entries' counts and sums, summed over the task."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), length)
            x = np.pad(x, ((0, 0), (0, parts * width - length)))
            now = np.array([list(c) for c in batch.column("code").to_pylist()], np.int64).reshape(-1, parts)
            was = np.array([list(c) if c is not None else [-1] * parts for c in batch.column("was").to_pylist()], np.int64).reshape(-1, parts)
            for p in range(parts):
                moved = was[:, p] != now[:, p]
                own = np.hstack([np.ones((int(moved.sum()), 1), np.int64), x[moved, p * width : (p + 1) * width]])
                left = was[moved, p]
                np.add.at(total[p], now[moved, p], own)
                np.subtract.at(total[p], left[left >= 0], own[left >= 0])
        part, entry = np.nonzero(total.any(axis=2))
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "sums"])
        release()

    return run


def _kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int | None]:
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"), F.col(label_col).alias("label")).filter(finite_vectors(F.col("v")))
    length = common_length(rows, "v")
    most = float(bound(length or 1))
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * SCALE).cast("double"), F.lit(most)), F.lit(-most)).cast("int"))
    return rows.filter(F.size("v") == (length or 0)).select("vec_id", "label", whole.alias("v"), F.lit(None).cast("binary").alias("code")), length


def _first_entries(rows: DataFrame, count: int) -> list[list[int]]:
    """The vectors of the `count` smallest ids, ascending; of a repeated id the least vector."""
    ids = rows.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(count)
    firsts = rows.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    return [r["v"] for r in firsts.orderBy("vec_id").collect()]


def train(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The state after all rounds and the books (part, entry, position).

    Each round writes the state, vectors with their assignments of before and now, to
    the shared folder; the entries' counts and sums are a second table. The round's
    shuffle carries only what changed: each task adds up, over the parts whose
    assignment is not what it was, the vectors that came to an entry and those that
    left it, and sends at most one row for each entry, added to the sums of before.
    The driver sees the sums alone, parts x entries rows whatever the size.
    """
    width = -(-length // parts)
    first = np.array(_first_entries(rows, entries), np.int64).reshape(-1, length)
    first = np.pad(first, ((0, 0), (0, parts * width - length)))
    books = np.stack([first[:, p * width : (p + 1) * width] for p in range(parts)])
    state, sums = rows, None
    for _ in range(rounds):
        state = cut(state.select("vec_id", "label", "v", "code").mapInArrow(_assigner(books, length, False), f"vec_id long, label {dict(rows.dtypes)['label']}, v array<int>, was binary, code binary"))
        changed = state.filter(~F.col("was").eqNullSafe(F.col("code"))).select("v", "was", "code")
        deltas = changed.mapInArrow(_deltas(books.shape, length), "part int, entry int, sums array<long>")
        both = deltas if sums is None else sums.unionByName(deltas)
        sums = cut(both.groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width + 1)]).alias("sums")))
        for r in sums.collect():
            n, *total = r["sums"]
            if n:
                books[r["part"], r["entry"]] = [t // n for t in total]
    return state, books


def books_digest(books: np.ndarray, length: int) -> str:
    """SHA-256 of all entries' components as decimal integers, by part, entry and position."""
    flat = ",".join(str(x) for x in books.reshape(-1).tolist()) if books.shape[0] * books.shape[2] == length else ",".join(
        str(x) for p, book in enumerate(books) for entry in book for x in entry[: max(0, min(books.shape[2], length - p * books.shape[2]))].tolist()
    )
    return hashlib.sha256(flat.encode()).hexdigest()


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that is kept; see train for the method.

    entries is at most 256, a byte of the code. All arithmetic is in integers, so the
    result doesn't depend on how rows are dealt.

    Edge cases: null and empty vectors and those with null or non-finite components
    are dropped, and so are vectors of another length than most have, which lack
    components or have too many. A length that doesn't divide is filled up with
    zeros. Integers saturate at `bound` (131,072 x 1024 for 64 components). With fewer
    ids than entries the books are smaller. A repeated row is coded each time; a
    repeated id starts one entry, its least vector; rows without id are coded but
    start none (if no row has an id, nothing can start and nothing is returned). Rows
    without label share one label_error. Without rows the result is empty; further
    columns are ignored.
    """
    rows, length = _kept(vectors, id_col, vec_col, label_col)
    schema = f"vec_id long, label {dict(rows.dtypes)['label']}, code string, error long"
    if length is None or not rows.filter("vec_id IS NOT NULL").limit(1).count():
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        return empty
    state, books = train(cut(rows), length, parts, entries, rounds)
    coded = cut(state.select("vec_id", "label", "v", "code").mapInArrow(_assigner(books, length, True), schema))
    by_label = cut(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(small_side(by_label), F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books, length)).alias("codebooks_sha256"))
