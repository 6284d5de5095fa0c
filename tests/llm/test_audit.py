"""The filter audit (op13) against every order run plainly."""

from itertools import permutations

import pytest

from tallyloom.llm.filter_audit import FILTERS, audit_filters, filter_masks, word_counts

WORDS = " ".join(f"word{i}" for i in range(220))
TEXTS = [
    (1, WORDS, "en"), (2, WORDS, "en"), (3, WORDS + " $", "en"), (4, "a " * 300, "en"), (5, None, None), (6, "", None), (7, "short", "de"), (8, "SHOUT " * 250, "de"),
    (9, WORDS.replace("word", "W"), "de"), (9, WORDS.replace("word", "W"), "de"), (None, WORDS, "en"), (11, WORDS, ""), (12, "é x\x1cy\tz\x0bq " * 90, "en"), (0, "short", "de"), (13, "x" * 50_000 + " " + WORDS, "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 0, None), (9, 1, 1), (None, 1, 1), (99, 1, 1)]


def fails(texts):
    """For each row the letters of the filters that it fails."""
    out = []
    for doc_id, text, _ in texts:
        t = text or ""
        words = t.encode().split()
        copy = any((o or "") == t and other is not None and doc_id is not None and other < doc_id for other, o, _ in texts)
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), copy)
        out.append({FILTERS[k] for k, bad in enumerate(tests) if bad})
    return out


def plain(texts, labels):
    rows, bad = [], fails(texts)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for part in {lang or "" for _, _, lang in texts}:
        docs = [k for k, (_, _, lang) in enumerate(texts) if (lang or "") == part]
        of_part, shapley = [], dict.fromkeys(FILTERS, 0)
        for order in permutations(FILTERS):
            alive, gone = set(docs), set()
            for step, f in enumerate(order, 1):
                now = {k for k in alive if f in bad[k]}
                alive -= now
                shapley[f] += len(now)
                ids = [texts[k][0] for k in now]
                of_part.append([part, "".join(order), step, len(alive), len(now), sum(f in bad[k] for k in gone), sum(bad[k] == {f} for k in docs), sum(i in good for i in ids), sum(i in toxic for i in ids), f])
                gone |= now
        rows += [(*r[:-1], shapley[r[-1]]) for r in of_part]
    return sorted(rows)


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, t, lang in TEXTS], "doc_id long, text string, lang string, part string, mask int, n int")
    return docs, spark.createDataFrame([(*r, "clash") for r in LABELS], "doc_id long, quality int, toxic int, text string")


def test_every_order_equals_a_plain_run(frames):
    docs, labels = frames
    got = sorted(tuple(r) for r in audit_filters(docs, labels).collect())
    assert got == plain(TEXTS, LABELS)
    assert len(got) == 600 * len({lang or "" for _, _, lang in TEXTS})


def test_masks_equal_plain_tests(frames):
    want = sorted((str(i), sorted(b)) for (i, _, _), b in zip(TEXTS, fails(TEXTS), strict=True))
    got = sorted((str(r.doc_id), sorted(f for k, f in enumerate(FILTERS) if r["mask"] >> k & 1)) for r in filter_masks(frames[0]).collect())
    assert got == want


def test_long_texts_are_counted_in_pieces():
    text = (" ".join(f"w{i % 700}\t\tx{i}" for i in range(3000))).encode()
    for piece in (1, 7, 1000, len(text), 10 * len(text)):
        assert word_counts(text, piece) == (6000, 3700)
    assert word_counts(b"", 1) == (0, 0)
    assert word_counts(b"a" * 5000 + b" b", 10) == (2, 2)


def test_empty_tables(spark, frames):
    docs, labels = frames
    assert audit_filters(docs.limit(0), labels).collect() == []
    rows = audit_filters(docs, labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert set(rows) == {0}
