"""Cross-entropy difference of documents under a target and a background n-gram model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import plain_words
from .frames import BROADCAST_ROWS, cut
from .kernels import chunks, hash_words, mix64, release

#: The uniform model spreads over 2^18 words, or over all distinct words of the corpus if there are more.
WORD_BITS = 18
#: Weight, in counts, of the word model within the pair model, and of the uniform model within the word model.
PRIOR = 2.0
#: A word or pair with at least this part of all occurrences is frequent; so there are never more than FREQUENT of them.
FREQUENT = 50_000
#: Characters and documents of a chunk, the unit in which a task reads its texts; word pairs of a bucket, the unit in which counts are summed.
CHUNK_CHARS, CHUNK_DOCS, BUCKET_PAIRS = 3_000_000, 16_000, 1_000_000

_START = np.uint64(0x51ED270B35A1F0C3)
_KINDS = (1, 0)  # target, background


def word_pairs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the word before (or the start) and of the word itself, for every word of the texts in turn, and where each text ends."""
    words, ends = [], []
    for text in texts:
        words += plain_words(text)
        ends.append(len(words))
    hashed, ends = mix64(hash_words(words)), np.array(ends, int)
    earlier = np.empty_like(hashed)
    earlier[1:] = hashed[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    earlier[starts[starts < len(hashed)]] = _START
    return earlier, hashed, ends


def pair_keys(earlier: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(earlier * np.uint64(0x9E3779B97F4A7C15) + words)


def _ranges(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    for a, b in chunks(texts, CHUNK_CHARS):
        for i in range(a, b, CHUNK_DOCS):
            yield i, min(b, i + CHUNK_DOCS)


@dataclass
class Counts:
    """Counts (target, background) of some keys, sorted by key."""

    keys: np.ndarray
    n: np.ndarray  # (2, keys)

    @classmethod
    def of(cls, df: DataFrame) -> Counts:
        got = df.select("key", "target", "background").toArrow()
        keys = got["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], np.stack([got[k].to_numpy() for k in ("target", "background")])[:, order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), int), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def _count(flagged: DataFrame, only: object = None) -> DataFrame:
    """(is_pair, key, target, background) summed over the documents (text, is_target).

    All words; and of the pairs those in `only`, or, without it, in each chunk those with
    at least half a FREQUENT-th of its occurrences. What a pair has elsewhere is under half
    a FREQUENT-th of all, so a frequent pair is counted to half a FREQUENT-th at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, target = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), bool)
            for i, j in _ranges(texts):
                a, b, ends = word_pairs(texts[i:j])
                own = np.repeat(target[i:j], np.diff(np.concatenate([[0], ends])))
                pairs = pair_keys(a, b)
                if only is None:
                    kinds = [(False, b, own), (True, pairs, own)]
                else:
                    _, known = only.value.find(pairs)
                    kinds = [(True, pairs[known], own[known])]
                for is_pair, keys, flags in kinds:
                    distinct, inverse, both = np.unique(keys, return_inverse=True, return_counts=True)
                    targets = np.bincount(inverse[flags], minlength=len(distinct)).astype(np.int64)
                    use = both * 2 * FREQUENT >= len(keys) if is_pair and only is None else np.ones(len(distinct), bool)
                    columns = [pa.array(np.full(use.sum(), is_pair)), *[pa.array(c[use]) for c in (distinct.view(np.int64), targets, both - targets)]]
                    yield pa.RecordBatch.from_arrays(columns, ["is_pair", "key", "target", "background"])
        release()

    counted = flagged.select("text", "is_target").mapInArrow(run, "is_pair boolean, key long, target long, background long")
    return counted.groupBy("is_pair", "key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


@dataclass
class Models:
    """What all tasks share: frequent words and pairs with their counts, and the sizes of the models."""

    words: Counts
    pairs: Counts
    totals: tuple[int, int]
    space: int
    buckets: int
    leave_one_out: bool

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        """Keys in order have buckets in order."""
        return ((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)

    def own(self, n: np.ndarray, is_target: np.ndarray, k: int) -> np.ndarray | int:
        """The part of a count that is the scored document's own."""
        return n * (is_target == _KINDS[k]) if self.leave_one_out else 0

    def log_word(self, counts: np.ndarray) -> np.ndarray:
        """The loss of a word as context: what its pairs are divided by."""
        return np.log2(counts + PRIOR)

    def log_pair(self, counts: np.ndarray, words: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
        """The gain of a pair, from its count and that of its second word; at the start it counts at most PRIOR, as the start itself does."""
        word = (words + PRIOR * 1e-3) / (self.totals[k] + PRIOR * 1e-3 * self.space)
        return np.log2(np.where(start, np.minimum(counts, PRIOR), counts) + PRIOR * word)


_MESSAGE = "bucket int, chunk long, kind int, keys binary, runs binary, hot binary, pairs binary, docs binary, n binary, own binary"
_NAMES = [c.split()[0] for c in _MESSAGE.split(", ")]
_HEAD, _BY_WORD, _BY_PAIR, _LAST = range(4)


def _messages(shared):
    """mapInArrow function: documents (doc_id, text, is_target) to one head row a chunk, with what frequent words and pairs add, and one row for each bucket that the rest goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, chunk = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, target = batch.column(0), batch.column(1).to_pylist(), np.array(batch.column(2).to_pylist(), bool)
            for i, j in _ranges(texts):
                rows = list(_chunk_messages(models, texts[i:j], target[i:j]))
                head = [b"".join(np.asarray(x).tobytes() for x in rows[0][4])]
                chunk += 1
                known = ids.slice(i, j - i)
                columns: list[list] = [[] for _ in _NAMES]
                for bucket, kind, keys, runs, parts in rows:
                    values = (bucket, chunk, kind, keys, runs, *(parts if kind != _HEAD else (known.fill_null(0).to_numpy().tobytes(), head[0], known.is_null().to_numpy(zero_copy_only=False).tobytes(), b"", b"")))
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)
        release()

    return run


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the greatest needs."""
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _wide(cells, sizes: np.ndarray) -> np.ndarray:
    """Counts of several _narrow cells of these numbers of counts."""
    parts = [np.frombuffer(cell, f"<u{len(cell) // size}") for cell, size in zip(cells, sizes, strict=True) if size]
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


def _six_bytes(keys: np.ndarray) -> bytes:
    """48 bits of each key: of a million pairs of a bucket, two share them in one bucket of 500."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six_bytes(cells) -> np.ndarray:
    packed = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, 6)
    whole = np.zeros((len(packed), 8), np.uint8)
    whole[:, :6] = packed
    return whole.view("<u8").ravel()


def _chunk_messages(models: Models, texts: list[str | None], target: np.ndarray) -> Iterator[tuple]:
    """(bucket, kind, keys, run lengths, other columns) of a chunk, the head first."""
    a, b, ends = word_pairs(texts)
    docs = len(texts)
    sizes = np.diff(np.concatenate([[0], ends]))
    doc = np.repeat(np.arange(docs), sizes)
    with np.errstate(over="ignore"):
        salt = mix64(doc.astype(np.uint64) + np.uint64(1))
        pairs = pair_keys(a, b)
        _, first, n = np.unique(mix64(pairs ^ salt), return_index=True, return_counts=True)
        _, first_word, at_word, n_word = np.unique(mix64(b ^ salt), return_index=True, return_inverse=True, return_counts=True)
    own = n_word[at_word]  # how often the document has the word
    last = ends[sizes > 0] - 1
    hot_at, hot = models.words.find(b)
    pair_at, hot_pair = models.pairs.find(pairs[first])
    sums = np.zeros((2, docs))
    for k in (0, 1):
        # frequent words as contexts, in all places but a text's last
        for at, times, sign in ((first_word[hot[first_word]], n_word[hot[first_word]], 1.0), (last[hot[last]], 1, -1.0)):
            counts = models.words.n[k, hot_at[at]] - models.own(own[at], target[doc[at]], k) if len(at) else np.empty(0)
            sums[k] += np.bincount(doc[at], sign * times * models.log_word(counts), docs)
        at, times = first[hot_pair], n[hot_pair]
        if len(at):
            flags = target[doc[at]]
            counts = models.pairs.n[k, pair_at[hot_pair]] - models.own(times, flags, k)
            words = models.words.n[k, hot_at[at]] - models.own(own[at], flags, k)
            sums[k] -= np.bincount(doc[at], times * models.log_pair(counts, words, a[at] == _START, k), docs)
        sums[k] += np.where(sizes > 0, np.log2(2 * PRIOR), 0.0)
    yield int(models.bucket(b[:1] if len(b) else np.zeros(1, np.uint64))[0]), _HEAD, b"", b"", (sizes.astype(np.int64), *sums)

    def dealt(kind: int, keys: np.ndarray, at: np.ndarray, times: np.ndarray | None) -> Iterator[tuple]:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        buckets = models.bucket(keys)
        codes = (doc[at] * 4 + (a[at] == _START) * 2 + target[doc[at]]).astype("<u2")
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(keys)]]) if len(keys) else [0]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            new = np.flatnonzero(np.concatenate([[True], keys[x + 1 : y] != keys[x : y - 1]]))
            runs = _narrow(np.diff(np.append(new, y - x)))
            hot_ids = _narrow(hot_at[at[x:y]][new]) if kind == _BY_PAIR else b""
            each = _six_bytes(pairs[at[x:y]]) if kind == _BY_WORD else b""
            counts = _narrow(times[order[x:y]]) if times is not None else b""
            yield int(buckets[x]), kind, keys[x:y][new].tobytes(), runs, (hot_ids, each, codes[x:y].tobytes(), counts, _narrow(own[at[x:y]]))

    rest, times = first[~hot_pair], n[~hot_pair]
    by_word = ~hot[rest]
    yield from dealt(_BY_WORD, b[rest[by_word]], rest[by_word], times[by_word])
    yield from dealt(_BY_PAIR, pairs[rest[~by_word]], rest[~by_word], times[~by_word])
    rare_last = last[~hot[last]]
    yield from dealt(_LAST, b[rare_last], rare_last, None)


def _sum_bucket(shared):
    """applyInPandas function over a bucket: counts its words and pairs, and gives each chunk what they add to its documents; heads pass."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        models = shared.value
        heads = group[group.kind == _HEAD]
        out = [(r.chunk, True, r.hot, r.pairs, r.docs) for r in heads.itertuples()]
        body = group[group.kind != _HEAD].sort_values(["kind", "chunk"], kind="stable")
        if len(body):
            chunk_ids, chunk_no = np.unique(body.chunk.to_numpy(), return_inverse=True)

            def joined(frame, column, dtype):
                return np.frombuffer(b"".join(frame[column]), dtype)

            codes = joined(body, "docs", "<u2").astype(np.int64)
            entries = np.array([len(x) // 2 for x in body["docs"]])
            ends = np.cumsum(entries)
            places, place = np.unique(np.repeat(chunk_no, np.diff(ends, prepend=0)) * CHUNK_DOCS + (codes >> 2), return_inverse=True)
            sums = np.zeros((2, len(places)))
            word_counts: tuple[np.ndarray, list[np.ndarray]] | None = None
            for kind in (_BY_WORD, _BY_PAIR, _LAST):
                rows = np.flatnonzero((body.kind == kind).to_numpy())
                if not len(rows):
                    continue
                frame, here = body.iloc[rows], slice(ends[rows[0] - 1] if rows[0] else 0, ends[rows[-1]])
                runs = _wide(frame["runs"], np.array([len(x) // 8 for x in frame["keys"]]))
                distinct, inverse = np.unique(joined(frame, "keys", "<u8"), return_inverse=True)
                inverse, own = np.repeat(inverse, runs), _wide(frame["own"], entries[rows])
                start, flags = (codes[here] & 2) > 0, codes[here] & 1
                if kind == _LAST:
                    at = np.searchsorted(word_counts[0], distinct)[inverse]
                    for k in (0, 1):
                        sums[k] -= np.bincount(place[here], models.log_word(word_counts[1][k][at] - models.own(own, flags, k)), len(places))
                    continue
                n = _wide(frame["n"], entries[rows])
                split = [np.bincount(inverse, n * (flags == _KINDS[k]), len(distinct)) for k in (0, 1)]
                if kind == _BY_WORD:
                    word_counts = distinct, split
                    pair_ids, of_pair = np.unique(_from_six_bytes(frame["pairs"]), return_inverse=True)
                    pair_split = [np.bincount(of_pair, n * (flags == _KINDS[k]), len(pair_ids)) for k in (0, 1)]
                else:
                    hot = np.repeat(_wide(frame["hot"], np.array([len(x) // 8 for x in frame["keys"]])), runs)
                for k in (0, 1):
                    mine, mine_word = models.own(n, flags, k), models.own(own, flags, k)
                    if kind == _BY_WORD:
                        words = split[k][inverse] - mine_word
                        added = models.log_word(words) - models.log_pair(pair_split[k][of_pair] - mine, words, start, k)
                    else:
                        added = -models.log_pair(split[k][inverse] - mine, models.words.n[k, hot] - mine_word, start, k)
                    sums[k] += np.bincount(place[here], n * added, len(places))
            bounds = np.searchsorted(places, np.arange(len(chunk_ids) + 1) * CHUNK_DOCS)
            for chunk, x, y in zip(chunk_ids, bounds[:-1], bounds[1:], strict=True):
                out.append((chunk, False, (places[x:y] % CHUNK_DOCS).astype("<u2").tobytes(), sums[:, x:y].astype("<f4").tobytes(), b""))
        return pd.DataFrame(out, columns=["chunk", "is_head", "ids", "sums", "nulls"])

    return run


def _sum_chunk(group: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas function over a chunk: its documents with the sums of all buckets."""
    head = group[group.is_head].iloc[0]
    ids, nulls = np.frombuffer(head.ids, np.int64), np.frombuffer(head.nulls, bool)
    whole = np.frombuffer(head.sums, np.int64)
    sizes, sums = whole[: len(ids)], whole[len(ids) :].view(float).reshape(2, -1).copy()
    for r in group[~group.is_head].itertuples():
        some = np.frombuffer(r.ids, "<u2")
        sums[:, some] += np.frombuffer(r.sums, "<f4").reshape(2, -1)
    means = [np.where(sizes > 0, s / np.maximum(sizes, 1), np.nan) for s in sums]
    return pd.DataFrame({"doc_id": pd.Series(ids).astype("Int64").mask(nulls), "n_tokens": sizes, "target_loss": means[0], "background_loss": means[1]})


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", target: str = "quality = 1", label_id_col: str = "doc_id", leave_one_out: bool = False
) -> DataFrame:
    """One row (doc_id, n_tokens, target_loss, background_loss, score) for each row of docs.

    Documents with a label that satisfies `target` train the target model, all
    others the background model: models of the same order, smoothing and vocabulary,
    all words of the corpus. Losses are bits a word; score is target minus background
    loss, so the lower, the more like the target. With leave_one_out a document's own
    words and pairs are taken from the counts (not the totals) that score it.

    Words and pairs are known by 64-bit hashes (pairs by 48 bits within their bucket),
    as many as the corpus has, and are counted exactly. One scan counts words, a second the pairs that may be frequent
    (a FREQUENT-th of all occurrences or more: at most FREQUENT, which are broadcast,
    so that none makes a hot key). A third sends each document's other distinct pairs
    to the bucket of their second word (of the pair, if that word is frequent), once: a
    bucket sees all occurrences of its words and pairs, so it counts them and scores
    them at the same time, and only sums for documents go back. The number of buckets grows with
    the corpus, BUCKET_PAIRS to each. Texts aren't shuffled while the target's ids
    are few enough to broadcast.

    Edge cases: texts without words have n_tokens 0 and null losses and score; a
    document is a target if any of its labels is; without any target the target
    model is uniform; a text longer than a chunk is a chunk; repeated rows count and
    are scored each; rows with a null id are background; other columns of docs and
    labels are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = labels.filter(target).select(F.col(label_id_col).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    chosen = cut(chosen.withColumn("is_target", F.lit(True)))
    few = chosen.count() <= BROADCAST_ROWS
    flagged = rows.join(F.broadcast(chosen) if few else chosen, "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    if not few:
        flagged = cut(flagged)  # texts are shuffled once, and are read in one order whenever a task is run again

    seen = cut(_count(flagged))
    words = seen.filter("not is_pair")
    space, *totals = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("background"), F.lit(0))).first()
    total, both = sum(totals), F.col("target") + F.col("background")
    maybe = spark.sparkContext.broadcast(Counts.of(seen.filter(F.col("is_pair") & (both * (2 * FREQUENT) >= total))))
    exact = _count(flagged, maybe) if len(maybe.value.keys) else seen.filter("is_pair")
    frequent = both * FREQUENT >= total
    models = Models(Counts.of(words.filter(frequent)), Counts.of(exact.filter(frequent)), tuple(totals), max(space, 1 << WORD_BITS), max(1, -(-total // BUCKET_PAIRS)), leave_one_out)
    shared = spark.sparkContext.broadcast(models)

    sent = flagged.mapInArrow(_messages(shared), _MESSAGE)
    added = sent.groupBy("bucket").applyInPandas(_sum_bucket(shared), "chunk long, is_head boolean, ids binary, sums binary, nulls binary")
    scored = added.groupBy("chunk").applyInPandas(_sum_chunk, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
