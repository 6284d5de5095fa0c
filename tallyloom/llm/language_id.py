"""Language identification of words and documents by a linear-chain conditional random field."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, release

#: Labelled documents that the model is fitted on at most, in equal parts by language: the documented bound.
SAMPLE_DOCUMENTS = 500
#: Characters of each of them that are learned from at most, so that the sample is bounded in bytes too; predictions read whole texts.
SAMPLE_CHARS = 40_000
#: Characters of text featurised at once by a worker, whose arrays take some 150 bytes for each.
CHUNK_CHARS = 200_000
#: Bits of the hashed feature table; the longest character n-gram.
BITS, LONGEST = 18, 4
#: Words of a segment of a text; segments are swept side by side and then chained.
SEGMENT = 64
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True for code points of letters."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


@dataclass
class Words:
    """The words of some texts: `word` numbers them among the distinct ones, text i has those from ends[i-1] to ends[i]."""

    word: np.ndarray
    ends: np.ndarray
    features: np.ndarray  # hashed features of the distinct words, one after another
    starts: np.ndarray  # where each distinct word's features begin


def featurise(texts: list[str]) -> Words:
    """Words are runs of letters, lower-cased. Features: n-grams of up to LONGEST characters, word ends
    marked (so that prefixes and suffixes are features of their own), and the whole word (lexicon)."""
    lowered = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([len(t) for t in lowered])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]  # the one break before each word
    at = np.flatnonzero(keep)
    codes = np.where(letter[at], codes[at], 0).astype(np.uint64)
    breaks = np.flatnonzero(codes == 0)
    ends = np.searchsorted(at[breaks], bounds)
    if not len(breaks):
        return Words(np.empty(0, int), ends, np.empty(0, np.int32), np.empty(0, int))
    codes = np.append(codes, np.uint64(0))
    size = np.diff(np.append(breaks, len(codes) - 1))
    place = np.arange(len(codes) - 1) - np.repeat(breaks, size)
    with np.errstate(over="ignore"):
        spread = mix64(codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
        whole = np.add.reduceat(spread, breaks)
    _, first, word = np.unique(whole, return_index=True, return_inverse=True)
    # positions of the distinct words only, word by word
    own = size[first]
    offset = np.cumsum(own) - own
    position = np.repeat(breaks[first] - offset, own) + np.arange(own.sum())
    owner = np.repeat(np.arange(len(first)), own)
    hashes, owners = [mix64(whole[first])], [np.arange(len(first))]
    rolled = np.zeros(len(position), np.uint64)
    valid = np.ones(len(position), bool)
    last = len(codes) - 1
    for n in range(1, LONGEST + 1):
        current = codes[np.minimum(position + n - 1, last)]
        if n > 2:
            valid &= codes[np.minimum(position + n - 2, last)] != 0
        with np.errstate(over="ignore"):
            rolled = rolled * np.uint64(0x100000001B3) + current + np.uint64(n)
            mixed = mix64(rolled)
        use = valid if n > 1 else current != 0
        hashes.append(mixed[use])
        owners.append(owner[use])
    owner, table = np.concatenate(owners), (np.concatenate(hashes) & np.uint64((1 << BITS) - 1)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return Words(word, ends, table[order], np.searchsorted(owner[order], np.arange(len(first))))


def forward_backward(scores: np.ndarray, ends: np.ndarray, transitions: np.ndarray, want_transitions: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each word's label, and expected transition counts, of sequences that stop at `ends`.

    scores: (words, labels) log potentials; transitions: (labels, labels) log potentials.
    Each sequence is cut into segments whose transfer matrices are swept side by
    side, then chained, so a long text costs as much a word as a short one.
    """
    n, labels = scores.shape
    if not n:
        return scores, np.zeros_like(transitions)
    step = np.exp(transitions)
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    lengths = np.diff(np.concatenate([[0], ends]))
    parts = -(-lengths // SEGMENT)
    ordinal = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(ends - lengths, parts) + ordinal * SEGMENT
    size = np.minimum(SEGMENT, np.repeat(ends, parts) - begin)
    has_next = np.append(ordinal[1:] > 0, False)
    # longest segments first, so that those still running at step t are a prefix
    order = np.argsort(-size, kind="stable")
    running = np.searchsorted(-size[order], -np.arange(SEGMENT))
    index = np.minimum(begin[order] + np.arange(SEGMENT)[:, None], n - 1)
    potential = local[index]  # (step, segment, label)

    def unit(x, axes):
        return x / x.sum(axis=axes, keepdims=True)

    swept = np.broadcast_to(np.eye(labels), (len(size), labels, labels)).copy()
    for t, m in enumerate(running):
        moved = (swept[:m].reshape(m * labels, labels) @ step).reshape(m, labels, labels) * potential[t, :m, None, :]
        swept[:m] = unit(moved, (1, 2)) if t % 8 == 7 else moved
    transfer = np.empty_like(swept)
    transfer[order] = unit(swept, (1, 2))
    into = np.full((len(size), labels), 1 / labels)
    outof = np.full((len(size), labels), 1 / labels)
    by_ordinal = np.argsort(ordinal, kind="stable")
    edges = np.searchsorted(ordinal[by_ordinal], np.arange(ordinal.max() + 2))
    for k in range(len(edges) - 1):
        own = by_ordinal[edges[k] : edges[k + 1]]
        own = own[has_next[own]]
        into[own + 1] = unit(np.einsum("il,ilm->im", into[own], transfer[own]), 1)
    for k in range(len(edges) - 2, -1, -1):
        own = by_ordinal[edges[k] : edges[k + 1]]
        own = own[has_next[own]]
        outof[own] = unit(np.einsum("ilm,im->il", transfer[own + 1], outof[own + 1]), 1)
    reached = np.zeros_like(potential)  # before the word's own potential
    after = np.ones_like(potential)
    alpha, beta = into[order], outof[order]
    for t, m in enumerate(running):
        reached[t, :m] = alpha[:m] @ step
        moved = reached[t, :m] * potential[t, :m]
        alpha[:m] = unit(moved, 1) if t % 8 == 7 else moved
    for t in range(SEGMENT - 1, -1, -1):
        m = running[t]
        after[t, :m] = beta[:m]
        moved = (potential[t, :m] * beta[:m]) @ step.T
        beta[:m] = unit(moved, 1) if t % 8 == 0 else moved
    weight = potential * after
    joint = reached * weight
    total = joint.sum(axis=2, keepdims=True)
    real = np.arange(SEGMENT)[:, None] < size[order]
    posterior = np.empty_like(scores, dtype=float)
    posterior[index[real]] = (joint / np.where(total > 0, total, 1.0))[real]
    if not want_transitions:
        return posterior, np.zeros_like(transitions)
    before = np.concatenate([into[order][None], (reached * potential)[:-1]])
    scale = np.where(real[:, :, None], 1.0 / np.maximum(((before @ step) * weight).sum(axis=2, keepdims=True), 1e-300), 0.0)
    expected = np.einsum("smi,smj->ij", before * scale, weight) * step
    return posterior, expected


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (features, labels)
    transitions: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """(distinct words, labels)"""
        return np.add.reduceat(self.weights[words.features], words.starts, axis=0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[str]]:
        """Label of each text, its mean posterior over the words, and the words by their own labels as label:count, comma-joined.

        A text without a letter is UNDETERMINED with score 0 and ''.
        """
        labels, scores, by_word = [], [], []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= CHUNK_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            words = featurise([t or "" for t in texts[start:stop]])
            width = max(1, len(self.labels))
            sums, votes = np.zeros((stop - start, width)), np.zeros((stop - start, width), int)
            counts = np.diff(np.concatenate([[0], words.ends]))
            if len(words.word) and self.labels:
                some = counts > 0
                posterior, _ = forward_backward(self.emissions(words)[words.word].astype(float), words.ends[some], self.transitions, False)
                sums[some] = np.add.reduceat(posterior, (words.ends - counts)[some], axis=0)
                owner = np.repeat(np.arange(stop - start), counts)
                votes = np.bincount(owner * width + posterior.argmax(axis=1), minlength=votes.size).reshape(votes.shape)
            best = sums.argmax(axis=1)
            known = (counts > 0) & bool(self.labels)
            labels += [self.labels[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
            by_word += [",".join(f"{label}:{n}" for label, n in zip(self.labels, row, strict=False) if n) for row in votes.tolist()]
            scores.append(np.where(known, np.minimum(1.0, sums.max(axis=1) / np.maximum(counts, 1)), 0.0))
            start = stop
        return labels, np.concatenate(scores) if scores else np.empty(0), by_word


def fit(texts: list[str], langs: list[str], rounds: int = 20, rate: float = 0.5, ridge: float = 1e-6) -> Model:
    """Maximises the conditional likelihood of the words' labels by gradient steps (AdaGrad).

    Documents are in one language, code-switched text is not: training sequences
    splice runs of 5 to 40 words of differently labelled documents, so transitions
    between languages are learned too.
    """
    labels = sorted(set(langs))
    words = featurise(texts)
    counts = np.diff(np.concatenate([[0], words.ends]))
    truth = np.repeat(np.searchsorted(labels, langs), counts) if labels else np.empty(0, int)
    model = Model(labels, np.zeros((1 << BITS, max(1, len(labels))), np.float32), np.zeros((max(1, len(labels)),) * 2))
    if not len(truth):
        return model
    rng = np.random.default_rng(0)
    cuts, at = [], 0
    for end in words.ends:
        while at < end:
            cuts.append((at, min(end, at + int(rng.integers(5, 41)))))
            at = cuts[-1][1]
    order = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))])
    word, truth = words.word[order], truth[order]
    ends = np.append(np.arange(512, len(order), 512), len(order))
    target = np.eye(len(labels))[truth]
    inside = np.ones(len(truth), bool)
    inside[np.concatenate([[0], ends[:-1]])] = False
    seen = np.zeros_like(model.transitions)
    np.add.at(seen, (truth[np.flatnonzero(inside) - 1], truth[inside]), 1)
    repeats = np.diff(np.append(words.starts, len(words.features)))
    squares, squares_t = np.full(model.weights.shape, 1e-8), np.full(seen.shape, 1e-8)
    for _ in range(rounds):
        posterior, expected = forward_backward(model.emissions(words)[word].astype(float), ends, model.transitions)
        error = target - posterior
        by_word = np.stack([np.bincount(word, error[:, k], len(words.starts)) for k in range(len(labels))], axis=1)
        gradient = np.stack([np.bincount(words.features, np.repeat(by_word[:, k], repeats), 1 << BITS) for k in range(len(labels))], axis=1)
        gradient = gradient / len(truth) - ridge * model.weights
        squares += gradient**2
        model.weights += (rate * gradient / np.sqrt(squares)).astype(np.float32)
        moved = (seen - expected) / len(truth)
        squares_t += moved**2
        model.transitions += rate * moved / np.sqrt(squares_t)
    return model


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits a model to at most `sample` documents outside the held-out quarter, in equal parts by language, chosen by a hash of the id.

    The sample, bounded in rows and in characters, is fitted in one Spark task; only the weights, of fixed size, reach the driver.
    """
    text = F.substring(F.col(text_col).cast("string"), 1, SAMPLE_CHARS)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([], [])
    each = max(1, sample // len(counts))
    drawn, chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), F.lit(False)
    for lang, n in sorted(counts.items()):
        chosen = chosen | ((F.col("lang") == lang) & (drawn < int((1 << 20) * min(1.0, each / n)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs = [], []
        for batch in batches:
            texts += [t or "" for t in batch.column(0).to_pylist()]
            langs += batch.column(1).to_pylist()
        if texts:
            model = fit(texts, langs)
            columns = [pa.array([model.labels], pa.list_(pa.string())), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.transitions.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["labels", "weights", "transitions"])

    drawn_rows = rows.filter(chosen).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text", "lang").coalesce(1)
    fitted = drawn_rows.mapInArrow(run, "labels array<string>, weights binary, transitions binary").first()
    if fitted is None:
        return fit([], [])
    labels = list(fitted["labels"])
    weights = np.frombuffer(fitted["weights"], np.float32).reshape(1 << BITS, len(labels))
    return Model(labels, weights, np.frombuffer(fitted["transitions"]).reshape(len(labels), len(labels)))


def predicted(model: Model, spark_context, text: Column) -> Column:
    """A struct column (lang, score, words) for `text`; the model, of fixed size, is broadcast."""
    shared = spark_context.broadcast(model)

    @F.pandas_udf("lang string, score double, words string")
    def predict(texts: pd.Series) -> pd.DataFrame:
        labels, scores, words = shared.value.predict(list(texts.where(texts.notna(), None)))
        release()
        return pd.DataFrame({"lang": labels, "score": scores, "words": words})

    return predict(text.cast("string"))


def identify_languages(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, word_langs) for each document, from its whole text.

    score is the label's mean posterior over the words; word_langs has the labels of
    the words themselves, which tell code-switched text, as lang:count by lang.
    Edge cases: null texts and texts without a letter are `und` with score 0 and no
    word_langs, and so is everything if no row is labelled; a null doc_id is never
    held out and never trained on; a text of any length is read whole, in chunks of
    whole texts; rows are predicted independently, so repeated rows repeat their
    result; other columns are ignored, whatever their names.
    """
    model = train(docs, sample, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), predicted(model, docs.sparkSession.sparkContext, F.col(text_col)).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.words").alias("word_langs"))


def keep_identified(docs: DataFrame, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, whose language is determined with a score of `least` or more."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = docs.withColumn("__p", predicted(model, docs.sparkSession.sparkContext, docs[text_col]))
    return found.filter((F.col("__p.lang") != UNDETERMINED) & (F.col("__p.score") >= least)).drop("__p")
