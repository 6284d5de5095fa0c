"""Vectorised text kernels shared by the operators of this subpackage.

Everything here is a small numpy helper that runs inside a Spark task on one
batch of rows; partitioning, grouping and shuffling stay with Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

#: Characters of text handled at once, so that a batch of very long texts stays small in memory.
CHUNK_CHARS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Gives freed memory back to the system at a task's end: Python workers outlive their tasks and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of `width` word hashes, in order; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out *= np.uint64(0x100000001B3) ^ _ODD
            out += words[i : i + n]
        return mix64(out + np.uint64(width) * _ODD)


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only (what bytes.lower and bytes.split do)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words gives the whole sequence as one."""
    for a, b in chunks(texts):
        words, ends = [], []
        for text in texts[a:b]:
            words += ascii_words(text)
            ends.append(len(words))
        hashed = hash_words(words)
        del words
        rolled = shingle_hashes(hashed, width)
        start = 0
        for end in ends:
            n = end - start
            if n >= width:
                yield np.unique(rolled[start : end - width + 1])
            else:
                yield shingle_hashes(hashed[start:end], n) if n else np.empty(0, np.uint64)
            start = end


@lru_cache(maxsize=8)
def permutation(bits: int, seed: int) -> np.ndarray:
    """A fixed pseudo-random permutation of range(2**bits)."""
    with np.errstate(over="ignore"):
        keys = mix64(np.arange(1 << bits, dtype=np.uint64) * _ODD + np.uint64(seed))
    return np.argsort(keys, kind="stable").astype(np.int32)


class CirculantMinHash:
    """Signatures from two permutations (circulant MinHash).

    The first permutation, sigma, scatters the universe once. Coordinate k is the
    least value of the second, pi, over the scattered set with pi shifted by k
    places round the circle, so the k-th to the (k + 1)-th coordinate need no new
    permutation. All coordinates of an element are one run of the table of pi.
    """

    def __init__(self, size: int, bits: int = 20, seed: int = 1):
        self.size, self.mask = size, np.uint64((1 << bits) - 1)
        self.sigma = permutation(bits, 2 * seed)
        pi = permutation(bits, 2 * seed + 1)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: size - 1]]), size)

    def places(self, shingles: np.ndarray) -> np.ndarray:
        return self.sigma[(shingles & self.mask).astype(np.int64)]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """int32 array of `size` coordinates; the set must not be empty."""
        places, out = self.places(shingles), None
        for i in range(0, len(places), 1024):
            part = self.runs[places[i : i + 1024]].min(axis=0)
            out = part if out is None else np.minimum(out, part)
        return out


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit integers that spreads every input bit (murmur3's finaliser), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


class WideCirculantMinHash:
    """The same over a circle of 2**32 places, where even millions of shingles are sparse; both permutations are formulas, so a signature costs some ten times as much."""

    def __init__(self, size: int, seed: int = 1):
        self.shifts, self.seed = np.arange(size, dtype=np.uint32), np.uint64(seed)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.shifts), 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            places = (mix64(shingles + self.seed * _ODD) >> np.uint64(32)).astype(np.uint32)
            for i in range(0, len(places), 1024):
                out = np.minimum(out, mix32(places[i : i + 1024, None] + self.shifts).min(axis=0))
        return out.view(np.int32)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One int64 key for each band of `rows` coordinates; keys of different bands differ."""
    bands = signature.reshape(-1, rows).astype(np.uint64)
    out = np.arange(len(bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mix64(out * _ODD + bands[:, i] + np.uint64(1))
    return out.view(np.int64)
