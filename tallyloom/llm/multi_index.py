"""Near-duplicate vectors by an inverted multi-index: a product grid of two codebooks, visited from the nearest cells on, and exact cosines."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import connected_components, cut, small_side
from .kernels import release
from .lloyd import common_length, finite_vectors

#: Vectors a cell on average, which sets the words of a codebook, and words at most (a task is sent both books); beyond that cells hold more.
PER_CELL, MOST_WORDS = 16, 4096
#: Sampled vectors for each word of a codebook, and at least: the books and the reach of the traversal are fitted on them in one task.
PER_WORD, LEAST_SAMPLE = 16, 8192
#: Part of the pairs right at the threshold whose cells the traversal must reach.
RECALL = 0.995
#: Sampled vectors and neighbours among them that make a dense place a ball.
BALL_SAMPLE, BALL_LEAST = 4096, 8
#: Second words of a bucket of cells, and vectors on either side of a block of comparisons.
SPAN, BLOCK = 32, 1024
#: Unit vectors are rounded to this grid for everything that decides which cells are visited: sums of such integers are exact in any order.
GRID = 4096
#: A group of equal vectors with this part of all rows is hot: there are at most so many, they are broadcast, and their rows stay where they are.
HOT = 1000


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square over- or underflows."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def gridded(u: np.ndarray) -> np.ndarray:
    return np.rint(u * GRID)


def _lloyd(x: np.ndarray, words: int, rounds: int = 8) -> np.ndarray:
    """A codebook for the rows of x on the integer grid; words that lose all rows stay."""
    book = x[:words].copy()
    for _ in range(rounds):
        code = np.concatenate([((book * book).sum(axis=1) - 2 * x[a : a + 4096] @ book.T).argmin(axis=1) for a in range(0, len(x), 4096)])
        n = np.bincount(code, minlength=words)
        total = np.zeros_like(book)
        np.add.at(total, code, x)
        book[n > 0] = total[n > 0] / n[n > 0, None]
    return np.rint(book)


class MultiIndex:
    """Two codebooks, how far the traversal goes, and the balls of dense places."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float, balls: np.ndarray):
        self.books, self.reach, self.balls = (first, second), reach, balls

    @property
    def words(self) -> int:
        return len(self.books[0])

    @property
    def spans(self) -> int:
        return -(-self.words // SPAN)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all words of their books, less the halves' own squares: exact integers."""
        half = self.books[0].shape[1]
        return tuple((book * book).sum(axis=1) - 2 * part @ book.T for book, part in zip(self.books, (q[:, :half], q[:, half:]), strict=True))

    def traverse(self, d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The multi-sequence of one vector: cells of the grid by ascending sum of distances, until a sum exceeds the least by more than the reach.

        Both books are sorted by distance. Of the sorted grid a cell can only come after
        those before it in its row and column, so what has been visited is a staircase,
        and where it stops is found for each first word at once. Yields (first word,
        second words), nearest first.
        """
        by1, by2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        last = d1[by1[0]] + d2[by2[0]] + self.reach
        steps = np.searchsorted(d2[by2], last - d1[by1], side="right")
        for i, n in zip(by1, steps, strict=True):
            if n == 0:
                break
            yield int(i), by2[:n]


def fit(sample: np.ndarray, words: int, threshold: float) -> MultiIndex:
    """Codebooks, reach and balls from the rows of a sample.

    The reach is set by pairs made right at the threshold: a sampled vector and what
    results from turning it, by the angle of the threshold, towards another sampled
    vector. Such a pair is reached if either's cell is within the reach of the other;
    RECALL of them are. Closer pairs are reached more often.
    """
    u = units(sample)
    q, half = gridded(u), sample.shape[1] // 2
    words = min(words, len(u))
    first, second = _lloyd(q[:, :half], words), _lloyd(q[:, half:], words)
    index = MultiIndex(first, second, 0.0, np.empty((0, sample.shape[1])))

    n = min(len(u), 4096)
    x, z = u[:n], np.roll(u, 1 + len(u) // 2, axis=0)[:n]
    z = z - (z * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((z * z).sum(axis=1, keepdims=True))
    x, z = x[size[:, 0] > 1e-6], (z / np.maximum(size, 1e-6))[size[:, 0] > 1e-6]
    if len(x) and words > 1:
        y = threshold * x + math.sqrt(1 - threshold * threshold) * z
        at = [index.distances(gridded(v)) for v in (x, y)]
        rows = np.arange(len(x))
        over = [mine[0][rows, other[0].argmin(axis=1)] + mine[1][rows, other[1].argmin(axis=1)] - mine[0].min(axis=1) - mine[1].min(axis=1) for mine, other in (at, at[::-1])]
        index.reach = float(np.quantile(np.minimum(*over), RECALL, method="higher"))

    # dense places: the mean direction of many neighbours within half the angle
    near, dense = math.cos(math.acos(threshold) / 2), []
    some = u[:BALL_SAMPLE]
    close = [np.flatnonzero(row) for a in range(0, len(some), 512) for row in some[a : a + 512] @ some.T >= near]
    left = np.ones(len(some), bool)
    for i in sorted(range(len(some)), key=lambda i: (-len(close[i]), i)):
        members = close[i][left[close[i]]] if left[i] else ()
        if len(members) >= BALL_LEAST:
            dense.append(some[members].sum(axis=0))
            left[members] = False
    if dense:
        index.balls = units(np.array(dense))
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _fit_task(words: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_matrix(b.column(0)) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(np.vstack(parts), words, threshold))], pa.binary())], ["index"])
        release()

    return run


def _place_task(index: MultiIndex, threshold: float):
    """mapInArrow function: for each vector its cell, its ball, the buckets that it visits, and the balls that are linked as a whole.

    Buckets from 0 on are runs of SPAN cells, negative ones the balls (-1 - b).
    """
    angle = math.acos(threshold)
    inner, outer, slack = math.cos(angle / 2), math.cos(min(math.pi, 1.5 * angle)), 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                u = units(_matrix(part.column("v")))
                d1, d2 = index.distances(gridded(u))
                near = u @ index.balls.T if len(index.balls) else np.full((len(u), 1), -2.0)
                ball = np.where(near.max(axis=1) >= inner + slack, near.argmax(axis=1), -1)
                visits, whole = [], []
                for row in range(len(u)):
                    own = int(ball[row])
                    there = {-1 - int(b) for b in np.flatnonzero((near[row] < inner + slack) & (near[row] >= outer - slack)) if b > own}
                    if own < 0:
                        for i, seconds in index.traverse(d1[row], d2[row]):
                            there.update(i * index.spans + s for s in set((seconds // SPAN).tolist()))
                    visits.append(sorted(there))
                    whole.append([int(b) for b in np.flatnonzero(near[row] >= inner + slack) if b > own])
                i, j = d1.argmin(axis=1), d2.argmin(axis=1)
                home = np.where(ball >= 0, -1 - ball, i * index.spans + j // SPAN)
                least = d1.min(axis=1) + d2.min(axis=1)
                ints = [pa.array(x.astype(np.int32)) for x in (i, j, home)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("n"), part.column("v"), *ints, pa.array(least), pa.array(visits, pa.list_(pa.int32())), pa.array(whole, pa.list_(pa.int32()))],
                    ["node", "n", "v", "i", "j", "home", "least", "visits", "whole"],
                )
        release()

    return run


def _labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `size` places the least place that the links (a, b) lead to."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _compare(index: MultiIndex, threshold: float):
    """applyInArrow function: links between the visitors and the residents of one block.

    A pair that visits each other's cells meets twice and counts where the visitor has
    the smaller number. For each vector: its links here, with copies, and the least of
    those it is connected with here.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = {c: table[c].to_numpy() for c in ("bucket", "visitor", "node", "n", "i", "j", "least")}
        vectors = _matrix(table["v"].combine_chunks())
        bucket, visitor = int(column["bucket"][0]), column["visitor"].astype(bool)
        u = units(vectors)
        mine, theirs = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        linked = u[mine] @ u[theirs].T >= threshold
        linked &= column["node"][mine][:, None] != column["node"][theirs][None, :]
        if bucket >= 0 and len(mine) and len(theirs):
            first = bucket // index.spans
            d1, d2 = index.distances(gridded(u))
            last = column["least"] + index.reach
            linked &= (d1[mine, first][:, None] + d2[mine][:, column["j"][theirs]]) <= last[mine][:, None]
            q, r = np.nonzero(linked)
            x, y = mine[q], theirs[r]
            both = d1[y, column["i"][x]] + d2[y, column["j"][x]] <= last[y]
            keep = ~both | (column["node"][x] < column["node"][y])
            x, y = x[keep], y[keep]
        else:
            q, r = np.nonzero(linked)
            x, y = mine[q], theirs[r]
        # the same vector may be visitor and resident: one place for each node
        nodes, place = np.unique(column["node"], return_inverse=True)
        links = np.bincount(place[x], column["n"][y], len(nodes)) + np.bincount(place[y], column["n"][x], len(nodes))
        label = _labels(len(nodes), place[x], place[y])
        some = np.flatnonzero(links)
        return pa.table({"node": pa.array(nodes[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "least": pa.array(nodes[label[some]], pa.int64())})

    return run


def _blocks(placed: DataFrame) -> DataFrame:
    """The vectors as visitors and residents of blocks of at most about BLOCK each: a bucket with more of either is dealt in a grid, every visitor meeting every resident once."""
    visits = placed.select("node", F.explode("visits").alias("bucket"))
    sizes = placed.groupBy(F.col("home").alias("bucket")).agg(F.count(F.lit(1)).alias("residents"))
    sizes = sizes.join(visits.groupBy("bucket").agg(F.count(F.lit(1)).alias("visitors")), "bucket")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = cut(sizes.filter("visitors > 0").select("bucket", parts("residents").alias("columns"), parts("visitors").alias("rows")))
    sizes = small_side(sizes)
    row = ["node", "n", "v", "i", "j", "least"]
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = placed.select(*row, F.explode("visits").alias("bucket")).join(sizes, "bucket").withColumn("r", salt("rows")).withColumn("c", others("columns"))
    theirs = placed.select(*row, F.col("home").alias("bucket")).join(sizes, "bucket").withColumn("c", salt("columns")).withColumn("r", others("rows"))
    out = ["bucket", "r", "c", *row]
    return mine.select(*out, F.lit(1).alias("visitor")).unionByName(theirs.select(*out, F.lit(0).alias("visitor")))


def _distinct(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, print) with print null if a vector can't be compared, and nodes (node, print, n, rid, v), one for each distinct vector."""
    kind = dict(vectors.dtypes)[vec_col]
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    some = finite_vectors(F.col("v")) & F.exists("v", lambda x: x != 0)
    length = common_length(rows.filter(some), "v")
    good = some & (F.size("v") == (length or 0))
    good = F.coalesce(good, F.lit(False))
    # adding 0 makes -0.0 and 0.0 one
    same = F.transform("v", lambda x: x + F.lit(0).cast(x_type(kind)))
    rows = rows.select("vec_id", F.when(good, same).alias("v"))
    print_ = F.sha2(F.to_binary(F.to_json(F.struct("v")), F.lit("utf-8")), 256)
    groups = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rid"), F.count(F.lit(1)).alias("n"))
    nodes = cut(groups.select(F.monotonically_increasing_id().alias("node"), "n", "rid", "v", print_.alias("print")))
    return cut(rows.select("vec_id", F.when(F.col("v").isNotNull(), print_).alias("print"))), nodes


def x_type(kind: str) -> str:
    return "float" if kind == "array<float>" else "double"


def build_index(nodes: DataFrame, count: int, threshold: float) -> MultiIndex:
    """The index of the nodes' vectors, fitted in one task on a bounded sample: the vectors of least hash, PER_WORD for each word and LEAST_SAMPLE at least."""
    words = max(1, min(MOST_WORDS, round(math.sqrt(count / PER_CELL))))
    sample = nodes.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(max(LEAST_SAMPLE, PER_WORD * words)).select("v")
    made = sample.coalesce(1).mapInArrow(_fit_task(words, threshold), "index binary").first()
    return pickle.loads(made["index"])


def vector_links(nodes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """(node, links, component) for the nodes (node, n, v) that have a link; see near_vectors."""
    schema = f"node long, n long, v {dict(nodes.dtypes)['v']}, i int, j int, home int, least double, visits array<int>, whole array<int>"
    placed = cut(nodes.select("node", "n", "v").mapInArrow(_place_task(index, threshold), schema))
    met = cut(_blocks(placed).groupBy("bucket", "r", "c").applyInArrow(_compare(index, threshold), "node long, links long, least long"))

    # balls: all their members are linked, and so are vectors with a ball that is linked as a whole
    inside = placed.filter("home < 0").select("node", "n", (-1 - F.col("home")).alias("ball"))
    sizes = cut(inside.groupBy("ball").agg(F.sum("n").alias("members"), F.min("node").alias("least")))
    touched = placed.select("node", "n", F.explode("whole").alias("ball"))
    extra = touched.groupBy("ball").agg(F.sum("n").alias("more"))
    sizes = F.broadcast(cut(sizes.join(extra, "ball", "left").na.fill(0, ["more"])))  # at most BALL_SAMPLE / BALL_LEAST rows
    within = inside.join(sizes, "ball").select("node", (F.col("members") - F.col("n") + F.col("more")).alias("links"), "least")
    across = touched.join(sizes, "ball").select("node", F.col("members").alias("links"), "least")
    every = met.unionByName(within).unionByName(across)

    edges = every.filter("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    components = connected_components(edges)
    return every.groupBy("node").agg(F.sum("links").alias("links")).join(components.withColumnRenamed("component", "root"), "node", "left")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors: links of a cosine of threshold or more, in double precision.

    Equal vectors become one node. A sample gives two codebooks, one for each half of
    the vectors; their product is a grid of about one cell for PER_CELL nodes, and
    every node is in the cell of its halves' nearest words. A node visits the cells
    nearest to it in the order of the multi-sequence, up to the reach that finds
    RECALL of the pairs right at the threshold (fit), and its cosine with every
    resident of those cells is computed. Pairs that neither visits are missed: under
    0.5 % at the threshold, fewer above it. No pair below the threshold is linked.

    Places so dense that a sample shows them (about 0.2 % of all nodes) become balls of
    half the threshold's angle: any two in a ball are linked, by the triangle
    inequality, and count without being compared. Others meet a ball's members, in
    blocks, only within one and a half angles of its centre, where some may be linked,
    so no link with a ball is missed. A bucket's visitors and residents are dealt in
    blocks of about BLOCK each, and a block returns a row for each vector, never pairs.

    Edge cases: vectors that are null, empty, zero, hold null or non-finite
    components, or have another length than most, link with nothing and stay alone.
    Copies, also of one vec_id, link with each other; repeated vec_ids are rows of
    their own. A row without vec_id is compared like others and is no component's id
    unless none of its component has one; then it counts as kept. Without rows the
    result is empty; further columns are ignored.
    """
    rows, nodes = _distinct(vectors, id_col, vec_col)
    count = nodes.count()
    out = ["vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")]
    alone = rows.filter("print IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).select(out)
    if not count:
        return alone
    found = cut(nodes.select("node", "n", "rid", "print").join(vector_links(nodes, build_index(nodes, count, threshold), threshold), "node", "left"))
    least = small_side(cut(found.filter("root IS NOT NULL").groupBy("root").agg(F.min("rid").alias("component_id"))))
    total = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    results = cut(found.join(least, "root", "left").select("print", "n", total.alias("n_links"), F.coalesce("component_id", "rid").alias("component_id")))
    # hot copies are looked up where they are, the others by a join on their print
    is_hot, some = F.col("n") * HOT >= rows.count(), rows.filter("print IS NOT NULL")
    hot = F.broadcast(results.filter(is_hot).drop("n"))
    met = some.join(hot, "print").select(out)
    rest = some.join(hot.select("print"), "print", "left_anti").join(results.filter(~is_hot).drop("n"), "print").select(out)
    return met.union(rest).union(alone)
