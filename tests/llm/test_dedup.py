"""Exact and near deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import kernels, near_dedup
from tallyloom.llm.exact_dedup import drop_exact_copies, exact_groups
from tallyloom.llm.frames import connected_components
from tallyloom.llm.near_dedup import drop_near_copies, near_groups

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(texts):
    folded = [(t or "").translate(FOLD) for t in texts]
    out = []
    for i, f in enumerate(folded):
        same = [j for j, g in enumerate(folded) if f == g]
        out.append((i, max(same), len(same), i == max(same), hashlib.sha256(f.encode()).hexdigest()))
    return out


def test_exact_groups(docs_of):
    texts = ["Abc", "aBC", None, "", "É", "é", "x" * 300 + "a", "x" * 300 + "b", "x" * 300 + "A", "alone", "long " * 50_000, "LONG " * 50_000]
    got = sorted(tuple(r) for r in exact_groups(docs_of(texts), digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_exact(texts)
    assert sorted(r.doc_id for r in drop_exact_copies(docs_of(texts)).collect()) == [i for i, *_, kept, _ in brute_exact(texts) if kept]


def test_exact_without_digest_hashes_survivors_only(docs_of):
    got = {r.doc_id: r.text_sha256 for r in exact_groups(docs_of(["a", "bb", "BB"])).collect()}
    assert got[0] is None and got[1] == got[2] == hashlib.sha256(b"bb").hexdigest()


def test_exact_edge_cases(spark, docs_of):
    assert exact_groups(docs_of([])).count() == 0
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.group_size, r.kept) for r in exact_groups(repeated).collect())
    assert got == [(False, 1, 3, True), (False, 1, 3, True), (True, 0, 1, True), (True, 0, 3, False)]


def brute_near(texts, percent=85):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def near_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " \n ", "one two", "ONE  two", "a b c d e"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(60, 160))]
        for _ in range(12):  # chains of copies of copies, so links reach beyond one centre
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
            if rng.random() < 0.5:
                base = own
    passage = [word() for _ in range(30)]
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(30)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(docs_of, seed):
    texts = near_texts(seed)
    got = sorted(tuple(r) for r in near_groups(docs_of(texts)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_near(texts)
    assert sorted(r.doc_id for r in drop_near_copies(docs_of(texts)).collect()) == [i for i, *_, kept in brute_near(texts) if kept]


def test_one_large_group_of_near_copies(docs_of):
    """A star of copies that are near the base, and less near each other, with copies only linked at second hand."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    texts = []
    for _ in range(600):
        own = list(base)
        for _ in range(rng.choice((1, 2, 2, 3))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    got = sorted(tuple(r) for r in near_groups(docs_of(texts)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_near(texts)


def test_near_edge_cases(spark, docs_of):
    assert near_groups(docs_of([])).count() == 0
    repeated = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_groups(repeated).collect())
    assert got == [(False, 2, 2, True), (False, 3, 2, False), (False, 3, 2, False), (True, 0, None, True)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="aB é\t\n\x1c", max_size=60))
def test_words_are_those_of_the_contract(text):
    expected = re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD))
    assert [w.decode() for w in kernels.ascii_words(text)] == expected


def test_circulant_coordinates_estimate_jaccard():
    import numpy as np

    values = kernels.mix64(np.arange(3000, dtype=np.uint64))
    minhash = kernels.CirculantMinHash(1024)
    a, b = minhash.signature(values[:2000]), minhash.signature(values[500:2500])
    assert abs((a == b).mean() - 0.6) < 0.06
    # coordinate k is the minimum under the table shifted by k places
    pi, places = kernels.permutation(20, 3), minhash.places(values[:50])
    assert a.shape == (1024,) and minhash.signature(values[:50])[7] == pi[(places + 7) % len(pi)].min()


def test_large_unrelated_sets_do_not_look_alike():
    """Over 2**20 places sets of millions agree in nearly all coordinates; wide signatures of sets at 1/3 agree in a third, of unrelated sets hardly."""
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 63, 4_500_000).astype(np.uint64)
    minhash = kernels.WideCirculantMinHash(320)
    a, b, c = minhash.signature(values[:1_500_000]), minhash.signature(values[750_000:2_250_000]), minhash.signature(values[3_000_000:])
    assert abs((a == b).mean() - 1 / 3) < 0.12 and (a == c).mean() < 0.02
    narrow = kernels.CirculantMinHash(320)
    assert (narrow.signature(values[:1_500_000]) == narrow.signature(values[3_000_000:])).mean() > 0.5


@pytest.mark.parametrize("large", [0, 40, 1000])
def test_sets_on_either_side_of_the_limit_meet(docs_of, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rng = random.Random(large)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for size in (20, 38, 40, 42, 44, 47, 60):
        own = [word() for _ in range(size + 4)]
        texts += [" ".join(own), " ".join([*own, word()]), " ".join(own[1:]), " ".join([*own, word(), word(), word()])]
    got = sorted(tuple(r) for r in near_groups(docs_of(texts)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == brute_near(texts)
