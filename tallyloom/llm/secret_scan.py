"""Secret scanning: fixed credential forms plus a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A match of ASSIGN contains one of these in lower case; most texts hold none and skip the slow pattern.
NAMES = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

#: Characters of keys; runs of at least LEAST of them are tested.
RUN, LEAST = re.compile(r"[A-Za-z0-9+/_=-]{8,}"), 16
#: Hexadecimal digests of the common hash functions, and dashed identifiers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Numbers in groups: telephone numbers, dates, versions.
GROUPED = re.compile(r"\+?[0-9]+(?:[-/_][0-9]+)+|\+[0-9]+")

#: Prose and identifiers get 2.5 to 10 characters from a token; random strings 1.0 to 1.9.
LEAST_EFFICIENT = 2.0
#: Runs of digits alone have longer tokens (random ones get 2.0 to 2.7 characters): their ratio is larger by this factor.
DIGITS = 1.375


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed forms, by start and kind."""
    found = []
    folded = text.lower()
    if any(name in folded for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def inefficient(run: str, encoding: tiktoken.Encoding, ratio: float) -> bool:
    """Few characters a token for a run of its alphabet."""
    return len(run) <= ratio * (DIGITS if run.isdigit() else 1) * len(encoding.encode_ordinary(run))


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding: tiktoken.Encoding, ratio: float, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Spans of further runs of `least` characters or more with few characters a token that are no digest, identifier or number in groups."""
    found, starts, reach = [], [a for a, _, _ in taken], []
    for _, _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    for m in RUN.finditer(text):
        if m.end() - m.start() < least:
            continue
        before = bisect_left(starts, m.end())
        if (before and reach[before - 1] > m.start()) or DIGEST.fullmatch(m[0]) or UUID.fullmatch(m[0]) or GROUPED.fullmatch(m[0]):
            continue
        if inefficient(m[0], encoding, ratio):
            found.append((m.start(), 3, m.end()))
    return found


def scan_text(text: str, encoding: tiktoken.Encoding | None = None, ratio: float = LEAST_EFFICIENT, least: int = LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The spans of the fixed forms of a text, and these with those of random strings (none without an encoding)."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, encoding, ratio, least)) if encoding else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = LEAST_EFFICIENT, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the fixed forms and all spans as kind:start:end.

    Fixed forms are assignments to credential names, access key ids and long hex
    runs. The token-efficiency test adds kind `random`: runs of `least` or more key
    characters (8 at least) that a tiktoken vocabulary (`vocabulary`, a rank file)
    encodes at `ratio` characters a token or fewer, whatever their alphabet; for digits
    alone the ratio is larger. Excluded are known digests, UUIDs
    and numbers in groups, by their form, and what a fixed form has found; a card
    number without separators is a run of digits like others. Measured
    over random strings of 16 to 48 characters at least 90 % are found in each of
    lower case, capitals, digits, base 32 and base 64 (`test_recall_by_alphabet`); of
    12 characters, with least=12, 75 to 98 %, and more words pass for random.

    Edge cases: null text counts as empty and gives zero counts and empty strings;
    offsets are code points of the whole text, which is scanned to its end in time
    proportional to its length, however long; a table without rows gives none; rows are independent, so repeated rows and null ids
    repeat their result; other columns are ignored, whatever their names.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base, every = scan_text(text, encoding, ratio, least)
                counts = [sum(k == kind for _, k, _ in base) for kind in (0, 1, 2)]
                digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((*counts, digest, _joined(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c, pa.string()) for c in columns[3:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
