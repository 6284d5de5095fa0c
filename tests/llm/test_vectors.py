"""Vector operators against brute force: the multi-index (op11) and integer Lloyd (op12)."""

import hashlib

import numpy as np
import pytest

from tallyloom.llm.lloyd import bound, compress_vectors, nearest
from tallyloom.llm.multi_index import fit, near_vectors, units

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n int, v string, print string, code string, error int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1, "clash", "clash", "clash", 1) for i, v, label in rows], SCHEMA)


def brute_links(rows, threshold=0.9):
    """(n_links, component) by place in rows, with every pair compared."""
    length = 8
    good = [k for k, (_, v, _) in enumerate(rows) if v is not None and len(v) == length and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = units(np.array([rows[k][1] for k in good], np.float32).astype(np.float64))
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    root = list(range(len(good)))
    for a, b in zip(*np.nonzero(linked), strict=True):
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    out = {k: (0, rows[k][0]) for k in range(len(rows))}
    for a, k in enumerate(good):
        ids = [rows[good[b]][0] for b in range(len(good)) if root[b] == root[a] and rows[good[b]][0] is not None]
        out[k] = (int(linked[a].sum()), min(ids, default=None))
    return [(rows[k][0], *out[k]) for k in range(len(rows))]


def clustered(seed, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 8))
    x = centres[rng.integers(0, 40, n)] + rng.normal(scale=0.25, size=(n, 8))
    x[:200] = centres[0] + rng.normal(scale=0.1, size=(200, 8))  # a dense place: a ball
    x[200:230] = centres[0]  # copies within it
    return [(i, [float(np.float32(c)) for c in v], i % 3) for i, v in enumerate(x)]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components_equal_brute_force(spark, seed):
    rows = clustered(seed)
    rows += [(5, rows[9][1], None), (None, rows[300][1], 1), (None, [9.0] * 7 + [-9.0], 1), (None, [-7.0, 9.0] * 4, 1)]  # a repeated id, rows without id
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [None] + [1.0] * 7, 1), (905, [float("inf")] * 8, 1), (906, [1.0] * 9, 1)]
    rows += [(907, [-0.0, 1.0] * 4, 1), (908, [0.0, 1.0] * 4, 1), (909, [1e30, 0.0] * 4, 1), (910, [1e-30, 0.0] * 4, 1)]
    got = near_vectors(frame(spark, rows)).collect()
    want = brute_links(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_blocks_and_balls_lose_nothing_and_count_nothing_twice(spark, monkeypatch):
    from tallyloom.llm import multi_index

    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "BALL_LEAST", 20)
    rows = clustered(3)
    got = near_vectors(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute_links(rows))


def test_traversal_visits_cells_nearest_first_and_stops_at_the_reach():
    rng = np.random.default_rng(4)
    index = fit(rng.normal(size=(500, 16)), 12, 0.9)
    assert index.reach > 0
    d1, d2 = rng.integers(0, 50, 12).astype(float), rng.integers(0, 50, 12).astype(float)
    index.reach = 20.0
    visited = {(i, int(j)) for i, seconds in index.traverse(d1, d2) for j in seconds}
    assert visited == {(i, j) for i in range(12) for j in range(12) if d1[i] + d2[j] <= d1.min() + d2.min() + 20}


def test_recall_of_pairs_right_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = units(rng.normal(size=(1500, 64)))
    z = rng.normal(size=(1500, 64))
    z = units(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.902 * x + np.sqrt(1 - 0.902**2) * z
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(np.vstack([x, y]).astype(np.float32))]
    got = near_vectors(frame(spark, rows)).agg({"n_links": "sum"}).first()[0]
    assert got >= 0.97 * 3000
    assert got <= 3000


def test_no_rows_and_no_vectors(spark):
    assert near_vectors(frame(spark, [])).collect() == []
    assert [tuple(r) for r in near_vectors(frame(spark, [(1, None, 0)])).collect()] == [(1, 0, 1, True)]
    assert compress_vectors(frame(spark, [])).collect() == []
    assert compress_vectors(frame(spark, [(1, None, 0), (None, [1.0] * 8, 0)])).collect() == []


def plain_lloyd(rows, entries, rounds=4, length=8):
    """(place: code, error) and the entries, in Python's integers."""
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v], label) for i, v, label in rows if v is not None and len(v) == length and all(c is not None and np.isfinite(c) for c in v)]
    width, books = length // 4, []
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(v, firsts.get(i, v))
    seeds = [firsts[i] for i in sorted(firsts)[:entries]]
    books = [[s[p * width : (p + 1) * width] for s in seeds] for p in range(4)]

    def assign():
        out = []
        for _, v, _ in kept:
            best = [min((sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(4)]
            out.append(best)
        return out

    for _ in range(rounds):
        at = assign()
        for p in range(4):
            for e in range(len(seeds)):
                own = [kept[k][1][p * width : (p + 1) * width] for k in range(len(kept)) if at[k][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = assign()
    errors = [sum(d for d, _ in best) for best in at]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in best), error, sum(x for (_, _, other), x in zip(kept, errors, strict=True) if other == label), digest) for (i, _, label), best, error in zip(kept, at, errors, strict=True)]


def test_codes_equal_plain_integers(spark):
    rows = clustered(6, 300)
    rows += [(7, rows[3][1], None), (7, rows[3][1], None), (None, rows[40][1], 1), (400, None, 1), (401, [1.0] * 3, 1), (402, [float("nan")] + [1.0] * 7, 0), (-1, [-1.5] * 8, None)]
    got = [tuple(r) for r in compress_vectors(frame(spark, rows), entries=16).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_lloyd(rows, 16), key=key)


def test_few_vectors_uneven_lengths_and_huge_components(spark):
    got = compress_vectors(frame(spark, [(i, [float(i), 0.5, -0.5, 2.0, 1.0, float(-i)], 0) for i in range(3)])).collect()
    assert [r.code for r in sorted(got)] == ["00000000", "01000001", "02000002"] or all(r.error == 0 for r in got)
    got = compress_vectors(frame(spark, [(0, [3e38] * 8, 0), (1, [-3e38] * 8, 0)]), entries=1).collect()
    most = bound(8)
    assert {r.error for r in got} == {8 * (2 * most) ** 2, 0} or sum(r.error for r in got) > 0


def test_nearest_takes_the_lower_index_of_a_tie_on_both_paths():
    book = np.array([[0, 0], [2, 0], [2, 0]])
    for scale in (1, 1 << 27):
        codes, far = nearest(np.array([[1, 0], [2, 0]]) * scale, book * scale)
        assert codes.tolist() == [0, 1]
        assert far.tolist() == [scale * scale, 0]
