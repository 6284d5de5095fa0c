"""Keyed state and joins on streams, and the commit graph, against plain versions."""

import random

import pytest

from tallyloom.operators import ancestry
from tallyloom.operators.ancestry import commits_between
from tallyloom.queries_streams import delivered
from tallyloom.session import stored
from tallyloom.streaming import state


def ancestors(commit, parents):
    seen, todo = set(), [commit]
    while todo:
        c = todo.pop()
        if c not in seen:
            seen.add(c)
            todo += [p for p in parents.get(c, ()) if p is not None]
    return seen


@pytest.mark.parametrize("doublings", [0, 2])
def test_commits_between_equal_sets_of_ancestors(spark, doublings):
    rng = random.Random(doublings)
    parents = {}
    for c in range(1, 90):
        near = [p for p in range(max(0, c - 6), c)]
        parents[c] = rng.sample(near, min(len(near), rng.choice((1, 1, 1, 2, 3))))
    moves = [(m, rng.choice([None, *range(90)]), rng.randrange(90)) for m in range(12)] + [(90, 80, 20), (91, 20, 20), (92, None, None), (93, 5, 999), (94, 999, 5)]
    edges = spark.createDataFrame([(c, p) for c, own in parents.items() for p in [*own, *own[:1]]] + [(0, None)], "commit long, parent long")
    numbers = spark.createDataFrame([(c,) for c in range(90)], "commit long").selectExpr("commit", "commit AS number")
    got = {(r.move, r["commit"]) for r in commits_between(edges, numbers, spark.createDataFrame(moves, "move long, before long, head long"), doublings).collect()}
    want = {(m, c) for m, before, head in moves if head is not None for c in ancestors(head, parents) - (ancestors(before, parents) if before is not None else set())}
    assert got == want


def test_rounds_go_with_the_range_not_with_the_history(spark, monkeypatch):
    # as in the query: every fourth goes on from the second before, every tenth merges the third before
    parents = {n: [n - 2 if n % 4 == 0 else n - 1] + [n - 3] * (n % 10 == 0) for n in range(4, 400)}
    edges = spark.createDataFrame([(c, p) for c, own in parents.items() for p in own], "commit long, parent long")
    numbers = spark.createDataFrame([(c,) for c in range(400)], "commit long").selectExpr("commit", "commit AS number")
    moves = [(h, h - 12, h) for h in range(360, 397, 12)] + [(1000, 372, 396)]
    rounds = []
    monkeypatch.setattr(ancestry, "stored", lambda df: rounds.append(1) or stored(df))
    got = {(r.move, r["commit"]) for r in commits_between(edges, numbers, spark.createDataFrame(moves, "move long, before long, head long")).collect()}
    assert got == {(m, c) for m, before, head in moves for c in ancestors(head, parents) - ancestors(before, parents)}
    assert len(rounds) <= 24


def test_window_pairs_keep_late_rows(spark):
    minute = 60
    commits = [(c, 1, 1_700_000_000 + c * 6 * 3600) for c in range(40)]
    messages = [(100 + m, 1 + m % 2, 1_700_000_000 + m * 3 * 3600 + (5 * minute if m % 4 else 0)) for m in range(80)]
    c = spark.createDataFrame(commits, "commit_id long, project_id long, at long").selectExpr("commit_id", "project_id", "timestamp_seconds(at) AS authored_at", "CAST(commit_id / 10 AS INT) AS slice")
    # two messages in ten come a slice late
    m = spark.createDataFrame(messages, "message_id long, project_id long, at long").selectExpr("message_id", "project_id", "timestamp_seconds(at) AS said_at", "CAST((message_id - 100) / 20 AS INT) + CAST(message_id % 10 < 2 AS INT) AS slice")
    got = {(r.commit_id, r.message_id) for r in delivered(spark, [c, m], lambda a, b: state.window_pairs(a, b, back="2 days", late="3 days"), "append", 5).collect()}
    want = {(a, b) for a, p, at in commits for b, q, said in messages if p == q and at - 2 * 86400 < said <= at + 300}
    assert got == want and len(want) > 100


def test_window_pairs_let_state_go(spark, tmp_path):
    held = {}
    for back in ("30 days", "6 hours"):
        for number in range(4):
            at = f"timestamp_seconds(1700000000 + id * 3600 + {number} * 50 * 3600)"
            spark.range(50).selectExpr(f"id + {number} * 50 AS commit_id", "1L AS project_id", f"{at} AS authored_at").write.mode("append").parquet(f"{tmp_path}/{back}/c")
            spark.range(50).selectExpr(f"id + {number} * 50 AS message_id", "2L AS project_id", f"{at} AS said_at").write.mode("append").parquet(f"{tmp_path}/{back}/m")
            c, m = (spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{back}/{t}").schema).parquet(f"{tmp_path}/{back}/{t}") for t in "cm")
            query = state.window_pairs(c, m, back=back).writeStream.option("checkpointLocation", f"{tmp_path}/{back}/k").foreachBatch(lambda batch, _: batch.count()).trigger(availableNow=True).start()
            query.awaitTermination()
        held[back] = sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])
    assert held["6 hours"] < 30 < 200 <= held["30 days"]


def test_window_totals_equal_pairs_without_them(spark, monkeypatch):
    rng = __import__("random").Random(5)
    day, ahead, start = 86_400, 300, 1_700_000_000
    commits = [(c, c % 2, start + rng.randrange(8 * day)) for c in range(120)]
    # some messages lie right at either end of a window
    edges = [at + d for _, _, at in commits[:30] for d in (ahead, ahead + 1, -2 * day, 1 - 2 * day)]
    messages = [(1000 + n, n % 2, at) for n, at in enumerate([*edges, *(start + rng.randrange(-2 * day, 8 * day) for _ in range(200))])]
    slices = lambda rows: [(i, p, at, max(0, (at - start) // (2 * day)) + (i % 10 < 2)) for i, p, at in rows]
    c = spark.createDataFrame(slices(commits), "commit_id long, project_id long, at long, slice int").selectExpr("commit_id", "project_id", "timestamp_seconds(at) AS authored_at", "slice")
    m = spark.createDataFrame(slices(messages), "message_id long, project_id long, at long, slice int").selectExpr("message_id", "project_id", "timestamp_seconds(at) AS said_at", "slice")
    monkeypatch.setattr(state, "window_pairs", lambda *_: 1 / 0)
    out = delivered(spark, [c, m], lambda a, b: state.window_totals(a, b, back_ms=2 * day * 1000, late="4 days"), "append", 6).collect()
    got, want = {}, {}
    for r in out:
        got.setdefault(r.commit_id, []).append((r.n_messages, r.first_message, r.last_message))
    got = {k: (sum(n for n, _, _ in v), min(a for _, a, _ in v), max(b for _, _, b in v)) for k, v in got.items()}
    for a, p, at in commits:
        ids = [b for b, q, said in messages if p == q and at - 2 * day < said <= at + ahead]
        if ids:
            want[a] = (len(ids), min(ids), max(ids))
    assert got == want and sum(n for n, _, _ in want.values()) > 5 * len(out)


def test_window_totals_let_state_go(spark, tmp_path):
    held = {}
    for back in (24 * 30, 6):
        for number in range(4):
            at = f"timestamp_seconds(1700000000 + id * 3600 + {number} * 50 * 3600)"
            spark.range(50).selectExpr(f"id + {number} * 50 AS commit_id", "1L AS project_id", f"{at} AS authored_at").write.mode("append").parquet(f"{tmp_path}/{back}/c")
            spark.range(50).selectExpr(f"id + {number} * 50 AS message_id", "id AS project_id", f"{at} AS said_at").write.mode("append").parquet(f"{tmp_path}/{back}/m")
            c, m = (spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{back}/{t}").schema).parquet(f"{tmp_path}/{back}/{t}") for t in "cm")
            query = state.window_totals(c, m, back_ms=back * 3_600_000).writeStream.option("checkpointLocation", f"{tmp_path}/{back}/k").foreachBatch(lambda batch, _: batch.count()).trigger(availableNow=True).start()
            query.awaitTermination()
        held[back] = sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])
    assert held[6] < 30 < 50 <= held[24 * 30]


def test_conversation_state_in_any_order_counts_repeats_once(spark):
    rows = [  # id, conversation, type, time, content, slice
        (1, 7, "prompt", 100_000, "a", 1), (2, 7, "prompt", 95_000, "a", 2), (3, 7, "prompt", 109_999, "a", 2), (4, 7, "prompt", 110_000, "a", 2), (5, 7, "answer", 50_000, "diff --git a/z b/z\ndiff --git a/y b/y", 2),
        (6, 7, "log", 40_000, "diff --git a/y b/y", 0), (7, 7, "log", 200_000, "diff --git a/(.+?) b/x", 0), (8, 8, "log", None, "x", 0), (9, None, "log", 5, "x", 0), (10, 8, "log", 10, "x", 3), (11, 8, "log", 10, "x", 3),
    ]
    frame = spark.createDataFrame([(i, c, "user", k, "", t, x, s) for i, c, k, t, x, s in rows], "id long, conversation_id long, role string, message_type string, model string, timestamp long, content string, slice int")
    out = delivered(spark, [frame], state.conversations_of, "update", 4).collect()
    last = {}
    for r in sorted(out, key=lambda r: r.batch):
        last[r.conversation_id] = (r.started_at, r.ended_at, r.user_prompt_count, r.files_edited, r.n_messages)
    # 95,000 and 109,999 lie within 10 s of 100,000 and 110,000 doesn't
    assert last == {7: (40_000, 110_000, 2, "y\nz", 5), 8: (10, 0, 0, "", 1)}


def test_heads_move_once_and_never_back(spark):
    sights = [("r", "main", "a", 1, 0), ("r", "main", "a", 2, 0), ("r", "main", "c", 9, 1), ("r", "main", "b", 5, 2), ("r", "dev", "a", 3, 2), ("r", "main", "d", 12, 2), ("r", "main", None, 20, 2), ("r", "main", "d", None, 2), ("r", "main", "a", 15, 3)]
    frame = spark.createDataFrame(sights, "repository string, branch string, head string, seen_at long, slice int")
    got = sorted((r.branch, r.before or "", r.head, r.seen_at) for r in delivered(spark, [frame], state.head_moves, "append", 4).collect())
    assert got == [("dev", "", "a", 3), ("main", "", "a", 1), ("main", "a", "c", 9), ("main", "c", "d", 12), ("main", "d", "a", 15)]


def test_state_of_a_conversation_has_an_entry_for_a_block_of_time_not_for_a_message():
    """Counts the calls that go to the state store for 5,000 messages within an hour, and holds the result to one by one."""
    import pandas as pd

    calls = []

    class Map(dict):
        def containsKey(self, k):
            calls.append(k)
            return k in self

        def getValue(self, k):
            calls.append(k)
            return self[k]

        def updateValue(self, k, v):
            calls.append(k)
            self[k] = v

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Map()

    processor = state.ConversationState()
    processor.init(Handle())
    start, kept = 7 * state.BLOCK_MS - 1_800_000 if hasattr(state, "BLOCK_MS") else 0, []
    for batch in range(2):
        times = [start + (i * 7919 * (batch + 1)) % 3_600_000 for i in range(5000)]
        frame = pd.DataFrame({"id": range(batch * 5000, batch * 5000 + 5000), "timestamp": times, "content": [i % 50 for i in range(5000)], "said": [i % 2 == 0 for i in range(5000)], "prompt": [i % 3 == 0 for i in range(5000)], "paths": [[f"f{i % 4}"] if i % 5 == 0 else None for i in range(5000)]})
        got = list(processor.handleInputRows((1,), iter([frame[:2000], frame[2000:]]), None))[0].iloc[0]
        for r in frame.sort_values(["timestamp", "id"]).itertuples():
            if not any(c == r.content and abs(t - r.timestamp) < 10_000 for c, t, *_ in kept):
                kept.append((r.content, r.timestamp, r.id, r.said, r.prompt, r.paths))
        files = {}
        for _, t, i, _, _, paths in kept:
            for p in paths or ():
                files[p] = min(files.get(p, (t, i)), (t, i))
        assert (got.started_at, got.ended_at, got.user_prompt_count, got.n_messages) == (min(k[1] for k in kept), max(k[1] for k in kept if k[3]), sum(k[4] for k in kept), len(kept))
        assert got.files_edited == "\n".join(sorted(files, key=files.get))
    assert len(calls) < 30
