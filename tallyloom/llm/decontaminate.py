"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut
from .kernels import CirculantMinHash, chunks, hash_words, release, shingle_hashes

WIDTH = 5
#: Coordinates of a signature, and bits of the universe that they permute.
SIZE, BITS = 64, 22
#: Shingles of test items searched for in one scan of the corpus: 16 MB in each task.
BLOCK_SHINGLES = 1_000_000
#: Rows of signatures held at once.
TILE = 1 << 15

_BREAKS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased: layout and marks don't count."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BREAKS).split()


class ItemIndex:
    """Test items of one block by size class: (2**(p-1), 2**p] shingles in partition p.

    A document meets partition p as overlapping windows of 1.5 * 2**p shingles, so
    item and window are of like size wherever the item stands and one equal
    coordinate of 64 is enough: an item of which 0.8 stands in a window goes unseen
    with probability under (1 - 0.25) ** 64 = 1e-8. Equal coordinates only nominate;
    the shared shingles of item and whole document decide.
    """

    def __init__(self, items: list[tuple[int, int, np.ndarray]]):
        """items: (item_id, shingle width, sorted distinct shingle hashes)."""
        self.items = items
        self.minhash = CirculantMinHash(SIZE, BITS, seed=2)
        self.partitions: dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        grouped: dict[tuple[int, int], list[int]] = {}
        for i, (_, width, shingles) in enumerate(items):
            grouped.setdefault((width, max(3, int(len(shingles) - 1).bit_length())), []).append(i)
        self.salts = ((np.arange(SIZE, dtype=np.int64) * 2654435761) & ((1 << BITS) - 1)).astype(np.int32)
        for (width, p), members in grouped.items():
            keys = np.concatenate([self._keys(self.minhash.signature(items[i][2])[None])[0] for i in members])
            owners = np.repeat(np.array(members), SIZE)
            order = np.argsort(keys, kind="stable")
            hint = np.zeros(1 << BITS, bool)
            for i in members:
                hint[self.minhash.signature(items[i][2]) ^ self.salts] = True
            self.partitions.setdefault(width, {})[p] = (keys[order], owners[order], hint)

    @staticmethod
    def _keys(signatures: np.ndarray) -> np.ndarray:
        return signatures.astype(np.int64) * SIZE + np.arange(SIZE)

    def candidates(self, rolled: np.ndarray, starts: np.ndarray, width: int) -> set[tuple[int, int]]:
        """(text index, item index) pairs; rolled: shingles of all texts, text i from starts[i] to starts[i + 1]."""
        found: set[tuple[int, int]] = set()
        partitions = self.partitions[width]
        step = 1 << (min(partitions) - 1)
        lengths = np.diff(starts)
        counts = -(-lengths // step)
        text = np.repeat(np.arange(len(lengths)), counts)
        edges = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]) * step, counts) + np.arange(len(text)) * step
        mins = np.empty((len(edges), SIZE), np.int32)
        ends = np.append(edges[1:], starts[-1])
        per_tile = max(1, TILE // step)
        for a in range(0, len(edges), per_tile):
            b = min(len(edges), a + per_tile)
            rows = self.minhash.runs[self.minhash.places(rolled[edges[a] : ends[b - 1]])]
            mins[a:b] = np.minimum.reduceat(rows, edges[a:b] - edges[a], axis=0)
        for p in range(min(partitions), max(partitions) + 1):
            if p in partitions and len(mins):
                last = np.searchsorted(text, text, side="right") - 1
                here = np.arange(len(text))
                windows = np.minimum(mins, mins[np.minimum(here + 1, last)])
                windows = np.minimum(windows, mins[np.minimum(here + 2, last)])
                keys, owners, hint = partitions[p]
                at, k = np.nonzero(hint[windows ^ self.salts])
                wanted = windows[at, k].astype(np.int64) * SIZE + k
                low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
                for t, x, y in zip(text[at][high > low], low[high > low], high[high > low], strict=True):
                    found.update((int(t), int(i)) for i in owners[x:y])
            if p < max(partitions) and len(mins):  # two blocks make one of the next size
                first = np.searchsorted(text, text)
                pair = (np.arange(len(text)) - first) % 2 == 0
                heads = np.flatnonzero(pair)
                mins, text = np.minimum.reduceat(mins, heads, axis=0), text[heads]
        return found

    def search(self, texts: list[str | None], containment: float) -> Iterator[tuple[int, int, int, int]]:
        """(text index, item_id, item's shingles, shared shingles) of each contained item."""
        for a, b in chunks(texts):
            words, ends = [], [0]
            for text in texts[a:b]:
                words += plain_words(text)
                ends.append(len(words))
            hashed, ends = hash_words(words), np.array(ends)
            for width in self.partitions:
                each = [shingle_hashes(hashed[x:y], width) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                starts = np.concatenate([[0], np.cumsum([len(e) for e in each])])
                rolled = np.concatenate(each)
                whole: dict[int, np.ndarray] = {}
                for t, i in sorted(self.candidates(rolled, starts, width)):
                    if t not in whole:
                        whole[t] = np.unique(each[t])
                    item_id, _, shingles = self.items[i]
                    shared = len(np.intersect1d(whole[t], shingles, assume_unique=True))
                    if shared >= containment * len(shingles) - 1e-9:
                        yield a + t, item_id, len(shingles), shared


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, width, shingles) of items that have words; items of fewer than WIDTH words are one shingle of their own width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashed = hash_words(plain_words(text))
                if len(hashed) and item_id is not None:
                    width = min(WIDTH, len(hashed))
                    rows.append((item_id, width, np.unique(shingle_hashes(hashed, width)).view(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            types = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item_id", "width", "shingles"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, width int, shingles array<long>")


def contained_items(
    docs: DataFrame, items: DataFrame, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """One row (doc_id, item_id, n_item, n_shared, containment) for each item of which a document holds `containment` or more.

    containment: the share of the item's distinct five-word shingles that the whole
    document has. The items are the query set: they are searched for in blocks of
    bounded size, each in one scan of the corpus without a shuffle, however many
    there are; a block is let go before the next is built.

    Edge cases: items without words are found nowhere; items of fewer than five words
    are matched as one sequence; null texts hold nothing; an item and a document that
    occur several times are reported once for each pair of rows; texts of any length
    are read whole; no items or no documents give no rows; other columns are ignored,
    whatever their names.
    """
    index = cut(item_shingles(items, item_col, item_text_col))
    total = index.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_SHINGLES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_item long, n_shared long, containment double"
    out = None
    for block in range(blocks):
        own = index.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        sets = [(r["item_id"], r["width"], np.array(r["shingles"], np.int64).view(np.uint64)) for r in own]
        shared_sets = docs.sparkSession.sparkContext.broadcast(sets)
        del own, sets

        def run(batches: Iterator[pa.RecordBatch], shared_sets=shared_sets) -> Iterator[pa.RecordBatch]:
            finder = ItemIndex(shared_sets.value) if shared_sets.value else None
            for batch in (whole.slice(a, 1024) for whole in batches for a in range(0, whole.num_rows, 1024)):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = [(ids[t], i, n, s, s / n) for t, i, n, s in finder.search(texts, containment)] if finder else []
                columns = list(zip(*found, strict=True)) or [()] * 5
                types = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])
            del finder
            release()

        part = rows.mapInArrow(run, schema)
        if blocks > 1:  # one block at a time is held by driver and executors
            part = cut(part)
            shared_sets.destroy()
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item; rows with a null id stay."""
    gone = cut(contained_items(docs, items, containment, id_col, text_col).select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
