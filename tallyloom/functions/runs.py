"""Hashes of texts that can be joined: that of a run of lines is made of those of its lines."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two primes below 2^31 and a base for each: sums of bytes times powers of the base, some 62 bits.
FIELDS = ((2_147_483_647, 912_310_441), (2_147_483_629, 1_403_580_781))
RUN = "h1 long, w1 long, h2 long, w2 long, n long"
#: Bytes of texts that are hashed at once, few enough for a processor's cache.
SLICE = 1 << 17


@lru_cache(16)
def _powers(field: int, least: int, inverse: bool = False) -> np.ndarray:
    """Powers of a field's base or of its inverse, `least` (a power of two) of them."""
    prime, base = FIELDS[field]
    out, step = np.ones(1, np.int64), pow(base, -1, prime) if inverse else base
    while len(out) < least:
        out = np.concatenate([out, out * step % prime])
        step = step * step % prime
    return out


def hashes(texts: pa.Array) -> pa.Array:
    """RUN of each text: its hash and the power of the base for its length, in either field, and its length in bytes."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data, sizes = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.diff(offsets)
    out = [np.zeros(len(sizes), np.int64) for _ in range(4)]
    begin = 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, "right")) - 1)
        starts, own = offsets[begin:end] - offsets[begin], sizes[begin:end]
        part, some = data[offsets[begin] : offsets[end]].astype(np.int64), own > 0
        least = 1 << max(17, len(part).bit_length())
        for field, (prime, _) in enumerate(FIELDS):
            powers = _powers(field, least)
            out[2 * field + 1][begin:end] = powers[own]
            if len(part):
                terms = part * powers[: len(part)]
                sums = np.add.reduceat(terms % prime if len(part) > 1 << 24 else terms, starts[some]) % prime
                out[2 * field][begin:end][some] = sums * _powers(field, least, True)[starts[some]] % prime
        begin = end
    return pa.StructArray.from_arrays([pa.array(c) for c in (*out, sizes)], ["h1", "w1", "h2", "w2", "n"])


def text_run(text: Column) -> Column:
    return F.arrow_udf(hashes, RUN)(text)


def joined(a: Column, b: Column) -> Column:
    """RUN of a text that is followed by another; null if one of them is."""
    parts = []
    for field, (prime, _) in enumerate(FIELDS, 1):
        h, w = f"h{field}", f"w{field}"
        parts += [((a[h] + a[w] * b[h]) % prime).alias(h), (a[w] * b[w] % prime).alias(w)]
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(*parts, (a["n"] + b["n"]).alias("n")))
