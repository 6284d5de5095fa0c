"""Packing of token pieces into sequences: patterns fitted to the length histogram, residuals by best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .frames import cut
from .kernels import release

#: Tokens of a length class beyond EXACT tokens. Such a length counts as the next multiple, which wastes UNIT / 2 on average; shorter ones count as they are.
UNIT, EXACT = 8, 256
#: Classes of rows that are ranked apart within one length class, so that a hot length is dealt to many tasks.
DEAL = 256
#: Parts of words remembered by a tokenizing worker before it starts anew, and bytes of text encoded at a time (or one text); only speed and memory depend on them.
REMEMBERED, AT_ONCE = 300_000, 8 << 20

# patterns of Arrow
_PLAIN = r"^(?P<base>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<mark>[^\sA-Za-z0-9'\x{80}-\x{10ffff}]*)$"
_RUN = r"^(?:[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+|[^\sA-Za-z0-9'\x{80}-\x{10ffff}]+)$"
_ODD_SPACE = r"[\x1c-\x1f]|<\|"


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat at starts, one after the other."""
    stops = np.cumsum(lengths)
    return flat[np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts - stops + lengths, lengths)]


class WordEncoder:
    """Ids of whole texts from ids of their words.

    The vocabulary's pre-tokenizer never joins text across white space, so the ids
    of a text are those of its white-space runs in turn. Texts are split and their
    distinct words and parts of words found by Arrow, many texts at once, so that no
    word is a step of Python; plain words are letters and a mark, whose parts are encoded
    many at a time. A text that may hold special tokens or separators on
    which the splits differ is encoded as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.array([False] * self.tokenizer.get_vocab_size())
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([""], pa.string())  # parts, the empty one first
        self.ids, self.starts, self.lengths = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _learn(self, parts: pa.Array) -> None:
        """Adds parts: those that are one run of letters or marks are encoded many at a time."""
        run = pc.match_substring_regex(parts, _RUN)
        joined, apart = parts.filter(run), parts.filter(pc.invert(run))
        runs, lengths = [self.ids], [self.lengths]
        some = joined.to_pylist()
        for a in range(0, len(some), 20_000):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some[a : a + 20_000])], add_special_tokens=False)[0].ids, "<u4")
            runs.append(ids)
            lengths.append(np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0))
        for got in self.tokenizer.encode_batch_fast(apart.to_pylist(), add_special_tokens=False):
            runs.append(np.array(got.ids, "<u4"))
            lengths.append(np.array([len(got.ids)]))
        self.known, self.ids, self.lengths = pa.concat_arrays([self.known, joined, apart]), np.concatenate(runs), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, and where each word's start and how many they are."""
        plain = pc.extract_regex(words, _PLAIN)
        base = pc.if_else(plain.is_null(), words, pc.utf8_lower(pc.struct_field(plain, "base")))
        parts = pa.concat_arrays([base, pc.fill_null(pc.struct_field(plain, "mark"), "")]).dictionary_encode()
        if len(self.known) > REMEMBERED:
            self._forget()
        at = pc.index_in(parts.dictionary, value_set=self.known)
        if at.null_count:
            self._learn(parts.dictionary.filter(at.is_null()))
            at = pc.index_in(parts.dictionary, value_set=self.known)
        pairs = at.to_numpy()[parts.indices.to_numpy()].reshape(2, -1).T.ravel()
        lengths = self.lengths[pairs]
        each = lengths.reshape(-1, 2).sum(axis=1)
        return _gathered(self.ids, self.starts[pairs], lengths), np.cumsum(each) - each, each

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        words = split.flatten().dictionary_encode()
        ids, starts, lengths = self._words(words.dictionary)
        word = words.indices.to_numpy()
        n = lengths[word]
        ids = _gathered(ids, starts[word], n)
        stops = np.concatenate([[0], np.cumsum(n)])[np.cumsum(split.value_lengths().to_numpy())].tolist()
        for i, (start, stop, whole) in enumerate(zip([0, *stops], stops, odd.to_pylist(), strict=False)):
            yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4") if whole else ids[start:stop]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batch, AT_ONCE bytes of text or one row at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE, side="right")))
        yield batch.slice(a, b - a)
        a = b


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for docs (doc_id, text): ids and the end id, cut to capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, 1):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = np.append(ids, np.array(end_id, "<u4"))
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def few_document_patterns(present: np.ndarray, total: int) -> np.ndarray:
    """All multisets of at most three present lengths that sum to `total`, one a row, largest first, padded with 0."""
    has = np.zeros(total + 1, bool)
    has[present] = True
    out = [np.array([[total, 0, 0]])] if has[total] else []
    a = np.arange(1, total)
    two = a[(a >= total - a) & has[a] & has[total - a]]
    out.append(np.stack([two, total - two, 0 * two], axis=1))
    x, y = np.meshgrid(present, present, indexing="ij")
    z = total - x - y
    fits = (x >= y) & (y >= z) & (z >= 1)
    x, y, z = x[fits], y[fits], z[fits]
    out.append(np.stack([x, y, z], axis=1)[has[z]])
    return np.concatenate(out)


def non_negative_least_squares(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum(x * pattern) near `wanted` (counts by length), by projected gradients with momentum.

    Short lengths weigh less: what is left of them fills gaps later.
    """
    size = len(wanted)
    weight = np.where(np.arange(size) * 8 < size, 0.1, 1.0)
    weight[0] = 0.0
    flat, n = patterns.ravel(), patterns.shape[1]

    def applied(x):
        return np.bincount(flat, np.repeat(x, n), size)

    scale = max(1.0, wanted.max())
    goal, x = wanted / scale, np.zeros(len(patterns))
    v = np.random.default_rng(0).random(len(patterns))
    for _ in range(20):
        v = ((weight * applied(v))[patterns]).sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm or 1.0
    step, y, t = 0.9 / max(norm, 1e-9), x, 1.0
    for _ in range(rounds):
        gradient = (weight * (applied(y) - goal))[patterns].sum(axis=1)
        fresh = np.maximum(0.0, y - step * gradient)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = fresh + (t - 1) / t2 * (fresh - x)
        x, t = fresh, t2
    return x * scale


def plan_sequences(counts: dict[int, int], total: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, repeats)] that uses up `counts` (by length class) in sequences of `total`.

    Works on the histogram alone; its size is bounded by the number of classes, whatever the corpus.
    """
    wanted = np.zeros(total + 1, np.int64)
    for length, n in counts.items():
        wanted[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    present = np.flatnonzero(wanted)
    patterns = few_document_patterns(present, total) if len(present) else np.empty((0, 3), int)
    if len(patterns):
        fitted = non_negative_least_squares(patterns, wanted.astype(float))
        for i in np.argsort(-fitted, kind="stable"):
            repeats = int(round(fitted[i]))
            if repeats <= 0:
                continue
            lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            repeats = min(repeats, int((wanted[lengths] // times).min()))
            if repeats > 0:
                wanted[lengths] -= repeats * times
                plan.append((tuple(int(x) for x in patterns[i] if x), repeats))
    # residuals, longest first, each into the fullest sequences with room, many equal ones at a time
    room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(total, 0, -1):
        left = int(wanted[length])
        while left:
            space = next((s for s in range(length, total) if room[s]), None)
            if space is None:
                each = total // length
                whole, rest = divmod(left, each)
                for repeats, filled in ((whole, each), (1 if rest else 0, rest)):
                    if repeats:
                        room[total - filled * length].append(((length,) * filled, repeats))
                left = 0
                continue
            lengths, repeats = room[space].pop()
            each = min(space // length, max(1, left // repeats))
            used = min(repeats, left // each)
            if used < repeats:
                room[space].append((lengths, repeats - used))
            room[space - each * length].append((lengths + (length,) * each, used))
            left -= used * each
    return plan + [entry for entries in room.values() for entry in entries]


def pack(
    docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document.

    Patterns of at most three length classes that fill a sequence are fitted to
    the length histogram by non-negative least squares and rounded; what they leave
    is packed by best fit on counts of classes. Only the histogram, of at most
    EXACT + capacity / UNIT numbers, reaches the driver. Pieces are then ranked within their
    class, in DEAL parts so that a hot length is no one task's, and a rank gives the
    sequence.

    Edge cases: null and empty texts are the end id alone; only longer documents
    than capacity are cut; repeated rows are packed once each; an empty table gives
    no rows; other columns are ignored.
    """
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unit = UNIT if capacity % UNIT == 0 else 1
    size_class = F.when(F.col("length") <= EXACT, F.col("length")).otherwise(F.ceil(F.col("length") / unit) * unit).cast("int")
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(DEAL)).cast("int")
    pieces = cut(token_pieces(rows, path, capacity)).withColumns({"class": size_class, "part": part})

    cells = pieces.groupBy("class", "part").count()
    before = F.sum("count").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    cells = cut(cells.select("class", "part", "count", F.coalesce(before, F.lit(0)).alias("before")))
    counts = {r["class"]: r["n"] for r in cells.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    places = _places(plan_sequences(counts, capacity))

    inner = W.partitionBy("class", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.join(F.broadcast(cells.select("class", "part", "before")), ["class", "part"])  # at most (EXACT + capacity / UNIT) * DEAL rows
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(inner) - 1)
    keys, low, base, slot = places

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.searchsorted(keys, frame["class"].to_numpy(np.int64) * _RANKS + frame["rank"].to_numpy(), side="right") - 1
            out = frame[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
            out["sequence_id"] = base[at] + frame["rank"].to_numpy() - low[at]
            out["slot"] = slot[at]
            yield out

    placed = ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, slot int")
    earlier = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.alias("offset"))


#: More ranks than a length class can have.
_RANKS = np.int64(1 << 50)


def _places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by class and rank: first key, first rank, first sequence and slot of each run of ranks."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for lengths, repeats in plan:
        for slot, length in enumerate(lengths):
            rows.append((length * int(_RANKS) + used[length], used[length], first, slot))
            used[length] += repeats
        first += repeats
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[:, 0].copy(), out[:, 1].copy(), out[:, 2].copy(), out[:, 3].copy()
