"""Ingestion of messages: classification, filters, suppression of repeats, insertion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import RATING_COMMANDS, is_rating_workflow
from ..session import stored

# The message types, the roles that may carry them, and prefixes of system and noise messages.
TYPE_ROLES = {"prompt": "user", "question": "agent", "answer": "user", "final_answer": "agent"}
SYSTEM_PREFIXES = ("<local-command", "<command-name", "<command-message", "<command-args", "<system-reminder", "<user-prompt-submit-hook", "[Request interrupted")
NOISE_PREFIXES = ("[response_item:reasoning]", "[event_msg:item_completed]", "[event_msg:token_count]")

#: Milliseconds within which an equal message is a repeat, and characters under which a bracketed one is hidden.
REPEAT_MS, HIDDEN_CHARS = 10_000, 256


def _starts(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


def infer_type(role: Column, content: Column, commands: tuple[str, ...] = RATING_COMMANDS) -> Column:
    """prompt for a user's text that isn't a command, else log."""
    text = F.trim(content)
    command = _starts(text, ("/", *commands)) | is_rating_workflow(content, commands)
    return F.when((F.trim(role) == "user") & (text != "") & ~command, "prompt").otherwise("log")


def canonical_type(role: Column, kind: Column, content: Column, commands: tuple[str, ...] = RATING_COMMANDS) -> Column:
    """The type a message is stored with: rating commands and types of the wrong role are logs, unknown types are inferred."""
    kind = F.trim(F.coalesce(kind, F.lit("")))
    out = F.when(is_rating_workflow(content, commands), "log").when(kind == "diff", "diff")
    for name, owner in TYPE_ROLES.items():
        out = out.when((kind == name) & (F.trim(role) == owner), name).when(kind == name, "log")
    return out.otherwise(infer_type(role, content, commands))


def is_system(content: Column) -> Column:
    return (content == "[]") | _starts(F.trim(content), SYSTEM_PREFIXES)


def is_noise(content: Column) -> Column:
    return _starts(content, NOISE_PREFIXES)


def hidden_on_ingest(content: Column) -> Column:
    """Short texts wholly in brackets."""
    text = F.trim(content)
    return (text != "") & (F.char_length(text) < HIDDEN_CHARS) & F.regexp_like(text, F.lit(r"(?s)^[\[<].*[\]>]$"))


def visible(content: Column) -> Column:
    """Messages that a conversation shows."""
    return ~F.trim(content).isin("", "[user]", "/clear", "/new")


#: Repeats up to which they are broadcast to the messages that they are taken from; beyond it the join shuffles.
BROADCAST_REPEATS = 500_000
REPEAT_KEY = ("conversation_id", "role", "message_type", "model", "content")


def suppress_repeats(messages: DataFrame, window_ms: int = REPEAT_MS, key: tuple[str, ...] = REPEAT_KEY) -> DataFrame:
    """messages without those within window_ms of the last kept message of the same key.

    The anchor is the last message that was kept, which no plain window function
    has: messages less than window_ms after the one before form a chain, found by a
    window; only within a chain is the fold needed, and a chain of one, nearly every
    message, needs none. A chain is folded as an array of times alone. Only those that
    go are joined to the messages, from a broadcast unless they are too many. A message
    without a time is nobody's repeat.
    """
    timed = messages.filter("timestamp IS NOT NULL")
    order = W.partitionBy(*key).orderBy("timestamp", "id")
    gap, next_gap = F.col("timestamp") - F.lag("timestamp").over(order), F.lead("timestamp").over(order) - F.col("timestamp")
    starts, ends = gap.isNull() | (gap >= window_ms), next_gap.isNull() | (next_gap >= window_ms)
    linked = timed.select(*key, "timestamp", "id", starts.cast("long").alias("__start"), (starts & ends).alias("__alone")).filter("NOT __alone")
    linked = linked.withColumn("__chain", F.sum("__start").over(order))
    times = linked.groupBy(*key, "__chain").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id"))).alias("all"))
    none = F.array().cast(times.schema["all"].dataType)

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (x["timestamp"] - last["timestamp"] >= window_ms), F.concat(kept, F.array(x))).otherwise(kept)

    own = F.xxhash64(*key).alias("__key")  # tells messages of one id and time apart
    gone = times.select(own, F.explode(F.array_except("all", F.aggregate(F.col("all"), none, step))).alias("g")).select("__key", "g.timestamp", "g.id")
    gone = stored(gone)
    gone = F.broadcast(gone) if gone.limit(BROADCAST_REPEATS + 1).count() <= BROADCAST_REPEATS else gone
    return messages.withColumn("__key", own).join(gone, ["__key", "timestamp", "id"], "left_anti").select(messages.columns)


def not_yet_stored(new: DataFrame, stored: DataFrame, window_ms: int = REPEAT_MS) -> DataFrame:
    """New messages without an equal stored one less than window_ms away.

    Times are in bins of six window_ms, and stored messages in the one or two that
    they reach, so the band is part of the equi join and a text that is stored over
    and over meets its neighbours in time only.
    """
    wide = 6 * window_ms
    bins = lambda t: F.floor(t / wide)
    reach = F.sequence(bins(F.col("timestamp") - window_ms), bins(F.col("timestamp") + window_ms))
    old = stored.select(*[F.col(k).alias(f"old_{k}") for k in REPEAT_KEY], F.col("timestamp").alias("old_timestamp"), F.explode(reach).alias("old_bin"))
    condition = (bins(new.timestamp) == old.old_bin) & (F.abs(new.timestamp - old.old_timestamp) < window_ms)
    for k in REPEAT_KEY:
        condition = condition & new[k].eqNullSafe(old[f"old_{k}"])
    return new.join(old, condition, "left_anti")


def added_messages(stored: DataFrame, new: DataFrame, commands: tuple[str, ...] = RATING_COMMANDS) -> DataFrame:
    """What ingestion adds of new to stored: classified, filtered, without repeats among themselves or of stored rows."""
    typed = new.withColumn("message_type", canonical_type(F.col("role"), F.col("message_type"), F.col("content"), commands))
    if "raw_json" in new.columns:  # what a payload marks as meta is no one's message
        meta = F.coalesce(F.get_json_object("raw_json", "$.isMeta") == "true", F.lit(False))
        typed = typed.withColumn("message_type", F.when(meta, "log").otherwise(F.col("message_type")))
    kept = suppress_repeats(typed.filter(~hidden_on_ingest(F.col("content")) & ~is_noise(F.col("content"))))
    return not_yet_stored(kept, stored).select(stored.columns)


def insert_messages(stored: DataFrame, new: DataFrame, commands: tuple[str, ...] = RATING_COMMANDS) -> DataFrame:
    """stored and what ingestion adds of new."""
    return stored.unionByName(added_messages(stored, new, commands))


def replace_derived_diffs(messages: DataFrame, derived: DataFrame) -> DataFrame:
    """derived rows take the place of rows at the same conversation, role and time."""
    return messages.join(derived.select("conversation_id", "role", "timestamp"), ["conversation_id", "role", "timestamp"], "left_anti").select(messages.columns).unionByName(derived)


def carry_forward(rows: DataFrame, value: str, partition: list[str], order: list[str]) -> DataFrame:
    """value filled from the last row that has one."""
    w = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def interpolate_times(rows: DataFrame, partition: str, order: str, time: str = "timestamp") -> DataFrame:
    """Missing times filled evenly between neighbours, by whole milliseconds, then made strictly increasing.

    Before the first known time it counts back, after the last it counts on, by 1 ms.
    """
    w = W.partitionBy(partition).orderBy(order)
    rows = rows.withColumn("__i", F.row_number().over(w).cast("long"))
    back, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known_at = F.when(F.col(time).isNotNull(), F.col("__i"))
    rows = rows.withColumns(
        {"__a": F.last(time, True).over(back), "__ai": F.last(known_at, True).over(back), "__b": F.first(time, True).over(on), "__bi": F.first(known_at, True).over(on)}
    )
    between = F.col("__a") + F.expr("(__b - __a) * (__i - __ai) div (__bi - __ai)")
    filled = F.when(F.col(time).isNotNull(), F.col(time)).when(F.col("__a").isNull(), F.col("__b") - (F.col("__bi") - F.col("__i")))
    filled = filled.when(F.col("__b").isNull(), F.col("__a") + (F.col("__i") - F.col("__ai"))).otherwise(between)
    rows = rows.withColumn("__t", filled)
    return rows.withColumn(time, F.max(F.col("__t") - F.col("__i")).over(back) + F.col("__i")).drop("__i", "__a", "__ai", "__b", "__bi", "__t")


def unique_times(rows: DataFrame, partition: str, time: str = "timestamp", tie: str = "id") -> DataFrame:
    """Times moved on to the next free millisecond: the running maximum of time less rank, plus rank."""
    w = W.partitionBy(partition).orderBy(time, tie)
    ranked = rows.withColumn("__i", F.row_number().over(w).cast("long"))
    return ranked.withColumn(time, F.max(F.col(time) - F.col("__i")).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__i")).drop("__i")
