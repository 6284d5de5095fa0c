"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import connected_components, cut
from .kernels import CirculantMinHash, WideCirculantMinHash, band_keys, mix64, release, shingle_sets

#: A pair at the threshold shares no band with at most this probability, by a signature of at most COORDINATES if 8 to 1 rows a band allow it.
MISS, COORDINATES = 3.1e-6, 400
#: Coordinates may agree this much less often than the threshold before a pair is passed over unverified:
#: six standard deviations of the estimate from 320 coordinates or more.
SLACK = 0.122
#: Shingles up to which a set's signature is over 2**20 places; larger sets would fill them and look alike, so theirs is over 2**32.
#: Sets just below have both, so that any two sets of similar size share one kind.
LARGE = 1 << 17
_WIDE = np.int64(0x5851F42D4C957F2D)  # sets the band keys of the second kind apart
#: Documents on a side of one block of comparisons.
BLOCK = 500


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows a band for a threshold: 40 of 8 at 85, 54 of 7 at 80."""
    for rows in range(8, 0, -1):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(math.log(MISS) / math.log1p(-share))
        bands = max(bands, math.ceil(320 / rows))
        if bands * rows <= COORDINATES:
            break
    return bands, rows


class _Signatures:
    """Signatures of the kinds that a set's size asks for."""

    def __init__(self, size: int, height: int, percent: int, large: int):
        self.narrow, self.wide, self.height = CirculantMinHash(size), WideCirculantMinHash(size), height
        self.most, self.least = large, large * percent / 100

    def of(self, s: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        return self.narrow.signature(s) if 0 < len(s) <= self.most else None, self.wide.signature(s) if 0 < len(s) >= self.least else None

    def bands(self, s: np.ndarray) -> np.ndarray | None:
        narrow, wide = self.of(s)
        keys = [band_keys(narrow, self.height)] if narrow is not None else []
        return np.concatenate(keys + ([band_keys(wide, self.height) ^ _WIDE] if wide is not None else [])) if len(s) else None


def _agreement(left: tuple, right: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Part of coordinates that a set's signatures share with others', by a kind that both have."""
    narrow, wide = left
    others_narrow, has_narrow, others_wide, has_wide = right
    out = np.zeros(len(has_narrow))
    if narrow is not None:
        out[has_narrow] = (others_narrow[has_narrow] == narrow).mean(axis=1)
    if wide is not None:
        by_wide = has_wide & ~(has_narrow & (narrow is not None))
        out[by_wide] = (others_wide[by_wide] == wide).mean(axis=1)
    return out


def _stacked(signatures: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    has = signatures.notna().to_numpy()
    out = np.zeros((len(has), size), np.int32)
    if has.any():
        out[has] = np.stack(signatures[has].to_numpy())
    return out, has


def _profile(width: int, percent: int, with_sets: bool):
    """mapInArrow function: (doc_id, text) to set size, set fingerprint and band keys, or to set and signature."""
    count, height = banding(percent)
    large = LARGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = _Signatures(count * height, height, percent, large)
        for batch in batches:
            ids = batch.column(0)
            for a in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(1).slice(a, 256).to_pylist(), width))
                own = ids.slice(a, 256)
                if with_sets:
                    narrow, wide = zip(*map(minhash.of, sets), strict=True)
                    columns = [own, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(narrow, pa.list_(pa.int32())), pa.array(wide, pa.list_(pa.int32()))]
                    names = ["rep", "shingles", "narrow", "wide"]
                else:
                    with np.errstate(over="ignore"):
                        prints = [(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s)) if len(s) else 0) for s in sets]
                    columns = [own, pa.array([len(s) for s in sets], pa.int64())]
                    columns += [pa.array(np.array([p[i] for p in prints], np.uint64).view(np.int64)) for i in (0, 1)]
                    columns.append(pa.array([minhash.bands(s) for s in sets], pa.list_(pa.int64())))
                    names = ["doc_id", "n_shingles", "print_a", "print_b", "bands"]
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _compare_blocks(percent: int):
    """applyInPandas function over two blocks of a bucket: links that join different components."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["rep", "side"])
        left, right = group[group.side == 0], group[group.side == 1]
        if not len(right):
            right = left
        size = math.prod(banding(percent))
        signatures = (*_stacked(right.narrow, size), *_stacked(right.wide, size))
        parent: dict[int, int] = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links = []
        others = list(zip(right.rep, right.component, right.shingles, strict=True))
        for rep, component, shingles, narrow, wide in zip(left.rep, left.component, left.shingles, left.narrow, left.wide, strict=True):
            near = _agreement((narrow, wide), signatures) >= percent / 100 - SLACK
            for j in np.flatnonzero(near):
                rep2, component2, shingles2 = others[j]
                a, b = root(component), root(component2)
                if a != b and _similar(shingles, shingles2, percent):
                    parent[max(a, b)] = min(a, b)
                    links.append((rep, rep2))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _relabel(nodes: DataFrame, links: DataFrame, key: str = "rep") -> DataFrame:
    """nodes with `component`: the least node reachable over links, or the node itself."""
    found = connected_components(links)
    return nodes.join(found.withColumnRenamed("node", key), key, "left").withColumn("component", F.coalesce("component", key))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each document.

    A document's set is its distinct runs of `width` words (whitespace-split, A-Z
    lower-cased); two documents are linked when 100 * intersection >= percent *
    union, and a component is what links reach.

    1. One scan makes each set's size, a 128-bit fingerprint and the band keys from
       a circulant MinHash signature, over a circle that is large beside the set
       (LARGE). Equal sets collapse to one representative, so
       a group of exact copies of any size is one node from here on.
    2. Each band's bucket links its members to one centre by exact Jaccard; the
       links give components. That is linear in a bucket.
    3. Buckets that still hold several components get the rest of the pairs: members
       outside the bucket's largest component against all others, in blocks of 500.
       A block drops a pair only if the coordinates rule it out or both are in
       one component already, so no link between components is lost, no pair is
       emitted unless it joins two, and no group is gathered in one task.

    Edge cases: texts without words have an empty set and are linked with nothing, and
    a table without rows gives none; a text of any length is one set, of 8 bytes a
    shingle in its task; fewer than `width` words make one shingle; a repeated doc_id is reported once
    per row and is linked with whatever any of its rows is linked with; rows with a
    null doc_id come back unlinked and kept, with component_id null; other columns
    are ignored. kept: doc_id is component_id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>"
    profile = cut(rows.mapInArrow(_profile(width, percent, False), schema))

    prints = ["n_shingles", "print_a", "print_b"]
    full = profile.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*prints).agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep"))
    classes = cut(classes)
    same = full.join(classes.select(*prints, "rep"), prints).filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    members = classes.select("rep", F.explode("bands").alias("band")).distinct()
    centres = members.groupBy("band").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(members.join(centres, "band").select("band", "rep", "centre", "size"))
    nodes = members.select("rep").distinct()
    wanted = rows.join(nodes, rows.doc_id == nodes.rep, "left_semi").dropDuplicates(["doc_id", "text"])
    sets = cut(wanted.mapInArrow(_profile(width, percent, True), "rep long, shingles array<long>, narrow array<int>, wide array<int>"))

    pairs = members.filter("rep != centre").select("rep", "centre").distinct()
    pairs = pairs.join(sets.select("rep", F.col("shingles").alias("x")), "rep")
    pairs = pairs.join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("y")), "centre")
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    enough = F.least(F.size("x"), F.size("y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent
    stars = cut(pairs.filter(enough & (both * 100 >= (total - both) * percent)).select(F.col("rep").alias("a"), F.col("centre").alias("b")))
    rest = _open_pairs(members.filter("size > 2"), _relabel(nodes, stars), sets, percent)

    links = same.union(stars).union(cut(rest))
    out = _relabel(profile.select(F.col("doc_id").alias("rep"), "n_shingles"), links)
    return out.select(
        F.col("rep").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("rep") == F.col("component"), F.lit(True)).alias("kept")
    )


def _open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found by comparing, in blocks, what a bucket's star has left in different components."""
    labelled = cut(members.join(labels, "rep").select("band", "rep", "component", (F.col("rep") == F.col("centre")).alias("is_centre")))
    # a bucket is open if its members other than the centre, which met all, are in two components
    sizes = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_centre")).alias("others"))
    largest = sizes.filter("others > 0").groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.max("n").alias("top"), F.count(F.lit(1)).alias("k"))
    largest = largest.filter("k > 1").select("band", "largest", F.ceil(F.col("top") / BLOCK).cast("int").alias("in_blocks"), F.ceil((F.col("all") - F.col("top")) / BLOCK).cast("int").alias("out_blocks"))
    dealt = cut(labelled.join(cut(largest), "band").withColumn("inside", F.col("component") == F.col("largest")))
    spread = F.xxhash64("rep", "band")
    inside = dealt.filter("inside").withColumn("i", F.pmod(spread, "in_blocks").cast("int"))
    inside = inside.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1))).select("band", "rep", "component", F.lit(0).alias("kind"), "i", "j", F.lit(0).alias("side"))
    outside = dealt.filter("not inside").withColumn("own", F.pmod(spread, "out_blocks").cast("int"))
    against = outside.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("in_blocks") - 1))).select("band", "rep", "component", F.lit(0).alias("kind"), "i", F.col("own").alias("j"), F.lit(1).alias("side"))
    other = F.explode(F.sequence(F.lit(0), F.col("out_blocks") - 1))
    among = outside.withColumn("other", other).select(
        "band", "rep", "component", F.lit(1).alias("kind"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    blocks = cut(inside.union(against).union(among))
    # bands repeat the same block of the same documents; each distinct one is compared once
    keys = ["band", "kind", "i", "j"]
    prints = blocks.groupBy(*keys).agg(F.sum(F.xxhash64("rep", "side").cast("decimal(38,0)")).alias("print"), F.countDistinct("component").alias("k"))
    once = prints.filter("k > 1").groupBy("kind", "print").agg(F.min(F.struct(*keys)).alias("first")).select("first.*")
    todo = blocks.join(cut(once), keys).join(sets, "rep")
    return todo.groupBy(*keys).applyInPandas(_compare_blocks(percent), "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of docs, all columns, but for those linked to a document of smaller doc_id."""
    gone = cut(near_groups(docs, id_col, text_col, width, percent).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
