"""Keyed state on streams: conversations as their messages come in, late or repeated, and the heads of branches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.messages import REPEAT_KEY, REPEAT_MS

#: State with lists and maps needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CONVERSATION = "conversation_id long, started_at long, ended_at long, user_prompt_count long, files_edited string, n_messages long"
TOTALS = "commit_id long, n_messages long, first_message long, last_message long"
MOVE = "repository string, branch string, before string, head string, seen_at long"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that list and map state need; before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


#: Time whose kept messages stand in one entry of a conversation's state, a multiple of REPEAT_MS.
BLOCK_MS = 7 * 24 * 3_600_000


class ConversationState(StatefulProcessor):
    """Bounds, counts and edited files of one conversation, from messages in any order.

    A message is a repeat if one of the same role, type, model and content that came
    before it lies less than REPEAT_MS away, on either side. Contents and times of kept
    messages are packed by blocks of time in a map state, so that a micro-batch reads
    and writes an entry for each block it touches, not for each message, however long
    the conversation; all else is one value. Edited files keep the place where each was
    first seen, and a late message may put one before others.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "started_at long, ended_at long, prompts long, messages long, paths array<string>, seen array<long>, ids array<long>, places array<int>")
        self.kept = handle.getMapState("kept", "block long", "contents binary, times binary")

    def _block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        packed = self.kept.getValue((number,)) if self.kept.containsKey((number,)) else (b"", b"")
        return np.frombuffer(packed[0], np.int64), np.frombuffer(packed[1], np.int64)

    def _fresh(self, contents: np.ndarray, times: np.ndarray) -> list[int]:
        """The places of the messages, in order, that repeat none kept before; they are kept now."""
        near = np.unique(np.concatenate([(times - REPEAT_MS) // BLOCK_MS, times // BLOCK_MS, (times + REPEAT_MS) // BLOCK_MS]))
        blocks = {int(n): self._block(int(n)) for n in near}
        seen: dict[tuple[int, int], list[int]] = {}
        for old_contents, old_times in blocks.values():
            mine = np.isin(old_contents, contents)
            for content, at in zip(old_contents[mine].tolist(), old_times[mine].tolist(), strict=True):
                seen.setdefault((content, at // REPEAT_MS), []).append(at)
        fresh = []
        for i, (content, at) in enumerate(zip(contents.tolist(), times.tolist(), strict=True)):
            number = at // REPEAT_MS
            if not any(abs(t - at) < REPEAT_MS for n in (number - 1, number, number + 1) for t in seen.get((content, n), ())):
                seen.setdefault((content, number), []).append(at)
                fresh.append(i)
        own = times[fresh] // BLOCK_MS
        for n in np.unique(own):
            old, new = blocks[int(n)], np.array(fresh)[own == n]
            self.kept.updateValue((int(n),), tuple(np.concatenate([x, y[new]]).tobytes() for x, y in zip(old, (contents, times), strict=True)))
        return fresh

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows)
        times, ids = frame["timestamp"].to_numpy(np.int64), frame["id"].to_numpy(np.int64)
        order = np.lexsort((ids, times))
        times, ids = times[order], ids[order]
        fresh = self._fresh(frame["content"].to_numpy(np.int64)[order], times)
        started, ended, prompts, messages, *lists = self.known.get() if self.known.exists() else (None, 0, 0, 0, [], [], [], [])
        files = {path: tuple(map(int, place)) for path, *place in zip(*lists, strict=True)}
        if fresh:
            times, ids, order = times[fresh], ids[fresh], order[fresh]
            said, paths = frame["said"].to_numpy(bool)[order], frame["paths"].to_numpy()[order]
            started = int(times[0]) if started is None else min(int(started), int(times[0]))
            ended = max([int(ended), *times[said].tolist()[-1:]])
            prompts, messages = int(prompts) + int(frame["prompt"].to_numpy(bool)[order].sum()), int(messages) + len(fresh)
            for at, i, named in zip(times.tolist(), ids.tolist(), paths, strict=True):
                for place, path in enumerate(named if named is not None else ()):
                    if path not in files or (at, i, place) < files[path]:
                        files[path] = (at, i, place)
            columns = [list(c) for c in zip(*files.values(), strict=True)] or [[], [], []]
            self.known.update((started, ended, prompts, messages, list(files), *columns))
        if started is not None:
            first = sorted(files, key=lambda p: (files[p], p))
            yield pd.DataFrame({"conversation_id": [key[0]], "started_at": [started], "ended_at": [ended], "user_prompt_count": [prompts], "files_edited": ["\n".join(first)], "n_messages": [messages]})

    def close(self) -> None:
        pass


def conversations_of(messages: DataFrame) -> DataFrame:
    """The state of each conversation that a micro-batch touches, from a stream of messages (columns of REPEAT_KEY, id, timestamp); for the update mode.

    There is no watermark: late messages count whenever they come. What the state needs
    of a message, a hash of its content and the paths it names, is computed before it
    is sent, so contents stay out of the state.
    """
    with_state_store(messages.sparkSession)
    path = F.transform(F.regexp_extract_all("content", F.lit(r"diff --git a/(.+?) b/"), F.lit(1)), lambda p: F.substring(F.trim(p), 1, 1024))
    narrow = messages.filter("timestamp IS NOT NULL AND conversation_id IS NOT NULL").select(
        F.col("conversation_id").cast("long"), "id", "timestamp", F.xxhash64(*[c for c in REPEAT_KEY if c != "conversation_id"]).alias("content"),
        F.col("message_type").isin("prompt", "answer").alias("said"), (F.col("message_type") == "prompt").alias("prompt"), F.filter(path, lambda p: ~p.isin("", "(.+?)")).alias("paths"),
    )
    return narrow.groupBy("conversation_id").transformWithStateInPandas(ConversationState(), CONVERSATION, "Update", "none")


class HeadState(StatefulProcessor):
    """The last head of one branch; a sight that is older than the last one is passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "head string, seen_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, seen_at = self.last.get() if self.last.exists() else (None, None)
        moves = []
        for r in pd.concat(rows).sort_values(["seen_at", "head"]).itertuples(index=False):
            if seen_at is not None and r.seen_at < seen_at:
                continue
            if r.head != head:
                moves.append((*key, head, r.head, int(r.seen_at)))
            head, seen_at = r.head, int(r.seen_at)
        self.last.update((head, seen_at))
        if moves:
            yield pd.DataFrame(moves, columns=["repository", "branch", "before", "head", "seen_at"])

    def close(self) -> None:
        pass


def head_moves(heads: DataFrame) -> DataFrame:
    """(repository, branch, before, head, seen_at): each change of a branch's head, from sights (repository, branch, head, seen_at); before is null at first sight."""
    with_state_store(heads.sparkSession)
    rows = heads.filter("head IS NOT NULL AND seen_at IS NOT NULL").select("repository", "branch", "head", "seen_at")
    return rows.groupBy("repository", "branch").transformWithStateInPandas(HeadState(), MOVE, "Append", "none")


def window_pairs(commits: DataFrame, messages: DataFrame, back: str = "7 days", ahead: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(commit_id, message_id, ...): pairs of one project with the message in (authored_at - back, authored_at + ahead], as two streams.

    commits: (commit_id, project_id, authored_at), messages: (message_id, project_id,
    said_at), times as timestamps. Both have watermarks, so a side's rows leave the
    state once the other can't bring a partner any more: messages `back` after they
    were said, commits `ahead` after they were authored.
    """
    c, m = commits.withWatermark("authored_at", late).alias("c"), messages.withWatermark("said_at", late).alias("m")
    within = F.expr(f"c.project_id = m.project_id AND m.said_at > c.authored_at - INTERVAL {back} AND m.said_at <= c.authored_at + INTERVAL {ahead}")
    return c.join(m, within).select("c.commit_id", "m.message_id", "c.project_id", "c.authored_at", "m.said_at")


def _totals(said: np.ndarray, ids: np.ndarray, ends: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, least and largest id of the messages that were said up to each end, or after it; (0, ?, ?) where there are none."""
    order = np.argsort(said, kind="stable")
    said, ids = said[order], ids[order]
    k = np.searchsorted(said, ends, side="right")
    n, at = np.where(upto, k, len(said) - k), np.where(upto, np.maximum(k - 1, 0), np.minimum(k, len(said) - 1))
    low, high = (np.where(upto, f.accumulate(ids)[at], f.accumulate(ids[::-1])[::-1][at]) for f in (np.minimum, np.maximum))
    return n, low, high


class WindowState(StatefulProcessor):
    """Messages of one project and one block of time, and the ends of commits' windows that lie in it, packed by micro-batch.

    New ends count all messages, older ones only the new messages; so what comes out is
    added to what came before. Everything goes once neither a message nor a commit
    can come that has to do with the block.
    """

    def __init__(self, width: int, back: int):
        self.width, self.back = width, back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "times binary, ids binary")
        self.ends = handle.getListState("ends", "times binary, ids binary, upto binary")

    @staticmethod
    def _unpacked(state, kinds: tuple) -> list[np.ndarray]:
        parts = list(state.get())
        return [np.concatenate([np.empty(0, kind), *(np.frombuffer(p[at], kind) for p in parts)]) for at, kind in enumerate(kinds)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows)
        times, ids, kind = (frame[c].to_numpy() for c in ("at", "id", "kind"))
        m = kind == 0
        said, said_ids, ends, end_ids, upto = times[m], ids[m], times[~m], ids[~m], kind[~m] == 1
        old_said, old_ids = self._unpacked(self.said, (np.int64, np.int64)) if len(ends) else (said[:0], said_ids[:0])
        asked = [(np.concatenate([old_said, said]), np.concatenate([old_ids, said_ids]), ends, end_ids, upto)]
        if len(said):
            asked.append((said, said_ids, *self._unpacked(self.ends, (np.int64, np.int64, np.bool_))))
            self.said.appendValue((said.tobytes(), said_ids.tobytes()))
        if len(ends):
            self.ends.appendValue((ends.tobytes(), end_ids.tobytes(), upto.tobytes()))
        self.handle.registerTimer(((int(key[1]) + 1) * self.width + self.back) // 1000 + 1)
        for said, said_ids, ends, end_ids, upto in asked:
            if len(said) and len(ends):
                n, low, high = _totals(said, said_ids, ends, upto)
                yield pd.DataFrame({"commit_id": end_ids, "n_messages": n, "first_message": low, "last_message": high})[n > 0]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.said.clear()
        self.ends.clear()
        yield pd.DataFrame(columns=["commit_id", "n_messages", "first_message", "last_message"]).astype("int64")

    def close(self) -> None:
        pass


def window_totals(commits: DataFrame, messages: DataFrame, back_ms: int = 7 * 24 * 3_600_000, ahead_ms: int = 5 * 60_000, late: str = "1 hour") -> DataFrame:
    """(commit_id, n_messages, first_message, last_message): what each micro-batch adds to the messages that `window_pairs` gives a commit, without a row for each pair; for the append mode.

    All windows are equally wide, so with time in blocks of that width a window is the
    end of one block and the start of the next: two running totals, in the state of a
    project and block. Work and state go with the rows, not with their pairs. Sums of n_messages, least first and
    largest last messages over batches are a commit's. commits: (commit_id long,
    project_id, authored_at), messages: (message_id long, project_id, said_at).
    """
    with_state_store(commits.sparkSession)
    back, width = back_ms * 1000, (back_ms + ahead_ms) * 1000
    high = F.unix_micros("authored_at") + ahead_ms * 1000
    both = F.array(F.struct(high.alias("at"), F.lit(1).alias("kind")), F.struct((high - width).alias("at"), F.lit(2).alias("kind")))
    c = commits.withWatermark("authored_at", late).filter("authored_at IS NOT NULL AND project_id IS NOT NULL")
    c = c.select("project_id", F.col("commit_id").cast("long").alias("id"), F.col("authored_at").alias("time"), F.inline(both))
    m = messages.withWatermark("said_at", late).filter("said_at IS NOT NULL AND project_id IS NOT NULL")
    m = m.select("project_id", F.col("message_id").cast("long").alias("id"), F.col("said_at").alias("time"), F.unix_micros("said_at").alias("at"), F.lit(0).alias("kind"))
    # a block is (k * width, (k + 1) * width]; the window's end lies in one, its start in the one before
    before = F.col("at") - 1
    rows = c.unionByName(m).withColumn("block", F.call_function("div", before - F.pmod(before, F.lit(width)), F.lit(width)))
    return rows.groupBy("project_id", "block").transformWithStateInPandas(WindowState(width, back), TOTALS, "Append", "eventTime")
