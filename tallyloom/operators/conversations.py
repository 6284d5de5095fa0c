"""Conversations: bounds, families, activity, ratings and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import RATING_COMMANDS, is_rating_command, is_rating_workflow, local_date
from .commits import calendar
from .messages import visible

#: Steps of a parent chain that are followed; longer chains keep the last root reached.
MOST_DEPTH = 32


def bounds(messages: DataFrame) -> DataFrame:
    """Per conversation: first time of any message, last time of a prompt or answer (0 if none), number of prompts."""
    said = F.col("message_type").isin("prompt", "answer")
    return messages.groupBy("conversation_id").agg(
        F.min("timestamp").alias("started_at"),
        F.coalesce(F.max(F.when(said, F.col("timestamp"))), F.lit(0)).alias("ended_at"),
        F.count_if(F.col("message_type") == "prompt").alias("user_prompt_count"),
    )


def run_spans(turns: DataFrame, run: str, time: str, value: str) -> DataFrame:
    """(run, values, span): of each run the distinct values it has seen, sorted, and the time from its first row to its last."""
    return turns.groupBy(run).agg(F.array_sort(F.collect_set(value)).alias("values"), (F.max(time) - F.min(time)).alias("span"))


def files_edited(messages: DataFrame) -> DataFrame:
    """(conversation_id, files): paths of the `diff --git` lines of any message in order of first sight, newline-joined.

    Paths are trimmed and cut after 1024 characters; a path that is the pattern of such lines itself doesn't count.
    """
    held = messages.filter(F.col("content").contains("diff --git a/"))
    path = F.substring(F.trim("path"), 1, 1024)
    found = held.select("conversation_id", "timestamp", "id", F.posexplode(F.regexp_extract_all("content", F.lit(r"diff --git a/(.+?) b/"), F.lit(1))).alias("at", "path"))
    found = found.withColumn("path", path).filter(~F.col("path").isin("", "(.+?)"))
    first = found.groupBy("conversation_id", "path").agg(F.min(F.struct("timestamp", "id", "at")).alias("seen"))
    return first.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "path"))), lambda x: x["path"]), "\n").alias("files"))


def family_roots(conversations: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(id, family_root_id): pointer doubling over parents, so a chain of length n takes log2(n) joins; a missing parent ends it."""
    known = conversations.select(F.col("id").alias("up"))
    state = conversations.select("id", F.col("parent_conversation_id").alias("up")).join(known, "up", "left_semi")
    state = conversations.select("id").join(state, "id", "left").select("id", F.coalesce("up", "id").alias("up"))
    for _ in range(max(1, (most_depth - 1).bit_length())):
        step = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = state.join(step, "up").select("id", F.col("next").alias("up"))
    return state.withColumnRenamed("up", "family_root_id")


def family_page(conversations: DataFrame, size: int = 20, number: int = 1, matching: DataFrame | None = None) -> DataFrame:
    """A page of families, newest first, with all members: the root, then children by start and id.

    conversations have family_root_id, started_at and ended_at; hidden ones are left
    out; with `matching` (id) only families of which a member matches. `shown_at` is
    the family's latest time on the root, the own time on children.
    """
    shown = conversations.filter(~F.col("hidden"))
    family = ["project_id", "family_root_id"]
    wanted = shown if matching is None else shown.join(shown.join(matching.select("id").distinct(), "id", "left_semi").select(*family).distinct(), family, "left_semi")
    latest = wanted.groupBy(*family).agg(F.max("ended_at").alias("family_ended_at"))
    ranked = latest.orderBy(F.desc("family_ended_at"), F.desc("family_root_id")).offset(size * (number - 1)).limit(size)
    is_root = F.col("id") == F.col("family_root_id")
    out = wanted.join(F.broadcast(ranked), family)  # at most a page of families
    return out.withColumn("shown_at", F.when(is_root, F.col("family_ended_at")).otherwise(F.col("ended_at"))).orderBy(
        F.desc("family_ended_at"), F.desc("family_root_id"), F.desc(is_root), "started_at", "id"
    )


def daily_activity(messages: DataFrame, conversations: DataFrame, first: str, last: str, zone: str | None = None, offset_minutes: int = 0, by_family: bool = False) -> DataFrame:
    """Each local day of [first, last): conversations (on the day of their last user message), prompts and answers.

    Hidden conversations don't count, nor does the first message of a child
    conversation, which its parent wrote. Days are calendar days of the zone.
    """
    shown = conversations.filter(~F.col("hidden")).select(
        F.col("id").alias("conversation_id"), F.coalesce(F.col("parent_conversation_id").cast("string"), F.lit("")).alias("parent"), (F.col("family_root_id") if by_family else F.col("id")).alias("unit")
    )
    # what lies before the range counts on no day of it; the first message is looked up for children alone, by an aggregate
    start = (F.unix_timestamp(F.lit(first), "yyyy-MM-dd") - 2 * 86_400) * 1000
    joined = messages.filter(F.col("timestamp") >= start).join(shown, "conversation_id")
    children = shown.filter("parent != ''").select("conversation_id")
    first_ids = messages.join(children, "conversation_id", "left_semi").groupBy("conversation_id").agg(F.min(F.struct("timestamp", "id")).alias("first")).select("conversation_id", F.col("first.id").alias("id"))
    said = joined.filter(F.col("role") == "user").join(first_ids, ["conversation_id", "id"], "left_anti")
    day = local_date(F.col("timestamp"), zone, offset_minutes)
    prompts = said.groupBy(day.alias("day")).agg(F.count_if(F.col("message_type") == "prompt").alias("prompts"), F.count_if(F.col("message_type") == "answer").alias("answers"))
    counted = said.filter(F.col("message_type").isin("prompt", "answer"))
    latest = counted.groupBy("unit").agg(F.max("timestamp").alias("timestamp")).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("conversations"))
    days = calendar(messages.sparkSession, first, last).join(F.broadcast(latest), "day", "left").join(F.broadcast(prompts), "day", "left")
    return days.select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("conversations", "prompts", "answers")])


def ratings_by_agent(conversations: DataFrame, ratings: DataFrame) -> DataFrame:
    """(agent, bucket, n): each conversation once, by its rounded mean rating held to 1..5, or 0 if unrated."""
    means = ratings.groupBy("conversation_id").agg(F.avg("rating").alias("mean"))
    joined = conversations.filter(~F.col("hidden")).join(means.withColumnRenamed("conversation_id", "id"), "id", "left")
    held = F.least(F.greatest(F.floor(F.col("mean") + 0.5), F.lit(1)), F.lit(5))  # these two pass over nulls
    bucket = F.when(F.col("mean").isNull(), 0).otherwise(held).cast("int")
    return joined.groupBy("agent", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def rating_totals(histogram: DataFrame) -> DataFrame:
    """Per agent: all and rated conversations, and the mean of the rated buckets."""
    rated = F.col("bucket") > 0
    out = histogram.groupBy("agent").agg(F.sum("n").alias("total"), F.sum(F.when(rated, F.col("n")).otherwise(0)).alias("rated"), F.sum(F.when(rated, F.col("bucket") * F.col("n")).otherwise(0)).alias("points"))
    return out.select("agent", "total", "rated", F.when(F.col("rated") > 0, F.col("points") / F.nullif(F.col("rated"), F.lit(0))).otherwise(0.0).alias("average"))


def orphaned_ratings(ratings: DataFrame, conversations: DataFrame) -> DataFrame:
    return ratings.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti")


def reconcile_nearest(ratings: DataFrame, history: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """(id, conversation_id): each orphaned rating with the nearest history entry of equal rating and note.

    history: (conversation_id, rating, note, timestamp). Both sides are put in bins
    of window_ms, so the band becomes an equi join on note, rating and bin of at
    most three bins; ties go to the newest entry, then to the least conversation.
    """
    bins = F.floor(F.col("created_at") / window_ms)
    left = ratings.withColumn("bin", F.explode(F.sequence(bins - 1, bins + 1))).withColumn("note", F.trim("note"))
    right = history.select(F.col("conversation_id").alias("found"), "rating", F.trim("note").alias("note"), "timestamp", F.floor(F.col("timestamp") / window_ms).alias("bin"))
    near = left.join(right, ["rating", "note", "bin"]).withColumn("gap", F.abs(F.col("timestamp") - F.col("created_at"))).filter(F.col("gap") <= window_ms)
    best = near.groupBy("id").agg(F.min(F.struct("gap", (-F.col("timestamp")).alias("newest"), "found")).alias("best"))
    return best.select("id", F.col("best.found").alias("conversation_id"), F.col("best.gap").alias("gap"))


def match_rating_commands(ratings: DataFrame, messages: DataFrame, window_ms: int = 120_000) -> DataFrame:
    """(rating_id, message_id): ratings, newest first, each take the nearest unused command of their conversation.

    Candidates come from an equi join on conversation and bin of window_ms; only
    conversations that have any reach the greedy step, one at a time.
    """
    bins = F.floor(F.col("created_at") / window_ms)
    asked = ratings.select("conversation_id", F.col("id").alias("rating_id"), "created_at", "seq", F.explode(F.array(bins - 1, bins, bins + 1)).alias("bin"))
    typed = messages.select("conversation_id", F.col("id").alias("message_id"), "timestamp", F.floor(F.col("timestamp") / window_ms).alias("bin"))
    candidates = asked.join(typed, ["conversation_id", "bin"]).filter(F.abs(F.col("created_at") - F.col("timestamp")) <= window_ms).drop("bin")

    def greedy(group):
        used, out = set(), []
        for _, own in group.sort_values(["created_at", "seq"], ascending=False, kind="stable").groupby(["created_at", "seq", "rating_id"], sort=False):
            free = own[~own.message_id.isin(used)]
            if len(free):
                gap = (free.timestamp - free.created_at).abs()
                best = free.assign(gap=gap).sort_values(["gap", "timestamp", "message_id"], ascending=[True, False, False]).iloc[0]
                used.add(best.message_id)
                out.append((best.rating_id, best.message_id))
        import pandas as pd

        return pd.DataFrame(out, columns=["rating_id", "message_id"], dtype="object").astype({"rating_id": "string", "message_id": "string"})

    typed = candidates.withColumns({"rating_id": F.col("rating_id").cast("string"), "message_id": F.col("message_id").cast("string")})
    return typed.groupBy("conversation_id").applyInPandas(greedy, "rating_id string, message_id string")


def resolve_alias(ratings: DataFrame) -> DataFrame:
    """(temp_conversation_id, conversation_id) by the newest rating that has the temporary id."""
    return ratings.filter("temp_conversation_id != ''").groupBy("temp_conversation_id").agg(F.max_by("conversation_id", F.struct("created_at", "seq")).alias("conversation_id"))


def under_five_stars(conversations: DataFrame, ratings: DataFrame) -> DataFrame:
    """Conversations with ratings of which none is 5."""
    rated = ratings.groupBy(F.col("conversation_id").alias("id")).agg(F.max((F.col("rating") == 5).cast("int")).alias("five")).filter("five = 0")
    return conversations.join(rated, "id", "left_semi")


def in_range(conversations: DataFrame, messages: DataFrame, start: int, end: int) -> DataFrame:
    """Conversations with a message in [start, end)."""
    own = messages.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end)).select(F.col("conversation_id").alias("id"))
    return conversations.join(own, "id", "left_semi")


def timeline_runs(turns: DataFrame, standalone: tuple[str, ...] = ("user",)) -> DataFrame:
    """Runs of consecutive turns: each standalone turn alone, others grouped. turns: (conv_id, turn, role, text)."""
    order = W.partitionBy("conv_id").orderBy("turn")
    alone = F.col("role").isin(*standalone)
    fresh = (alone | F.coalesce(F.lag(alone).over(order), F.lit(True))).cast("long")
    runs = turns.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("conv_id", "run").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n_turns"), F.min("role").alias("role"))


def detail(conversations: DataFrame, messages: DataFrame, ratings: DataFrame, conversation_id) -> dict[str, DataFrame]:
    """A conversation with its messages, ratings and children; a temporary id is followed by alias."""
    alias = resolve_alias(ratings).filter(F.col("temp_conversation_id") == conversation_id).select(F.col("conversation_id").alias("id"))
    own = conversations.filter(F.col("id") == conversation_id)
    own = own.unionByName(conversations.join(alias, "id", "left_semi")).dropDuplicates(["id"])
    key = own.select(F.col("id").alias("conversation_id"))
    return {
        "conversation": own,
        "messages": messages.join(key, "conversation_id", "left_semi").orderBy(F.desc("timestamp"), F.desc("id")),
        "ratings": ratings.join(key, "conversation_id", "left_semi").orderBy(F.desc("created_at"), F.desc("seq")),
        "children": conversations.join(own.select(F.col("id").alias("parent_conversation_id")), "parent_conversation_id", "left_semi").orderBy("started_at", "id"),
    }


def backfill_models(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages with the model of a new one of the same conversation and time where they have none."""
    named = new.filter(F.trim("model") != "").groupBy("conversation_id", "timestamp").agg(F.max("model").alias("__model"))
    out = messages.join(named, ["conversation_id", "timestamp"], "left")
    return out.withColumn("model", F.when(F.coalesce("model", F.lit("")) == "", F.coalesce("__model", "model")).otherwise(F.col("model"))).select(messages.columns)


def refreshed(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> DataFrame:
    """conversations after the messages `new` came: wider bounds (0 is unknown), and prompts and edited files counted anew from `messages`.

    Conversations without new messages stay as they are; rating commands and messages marked as meta don't widen bounds.
    """
    counted = ~is_rating_workflow(F.coalesce("content", F.lit("")))
    if "raw_json" in new.columns:
        counted = counted & (F.coalesce(F.get_json_object("raw_json", "$.isMeta"), F.lit("")) != "true")
    said = F.when(counted & F.col("message_type").isin("prompt", "answer"), F.col("timestamp"))
    wider = [F.min(F.when(counted, F.col("timestamp"))).alias("__start"), F.max(said).alias("__end")]
    prompts = F.count_if(F.col("message_type") == "prompt").alias("__prompts")
    if messages is new:  # all are counted anew, in one pass
        own, fresh = messages, messages.groupBy("conversation_id").agg(prompts, *wider)
    else:
        touched = new.groupBy("conversation_id").agg(*wider)
        own = messages.join(touched, "conversation_id", "left_semi")
        fresh = own.groupBy("conversation_id").agg(prompts).join(touched, "conversation_id", "left")
    fresh = fresh.join(files_edited(own).withColumnRenamed("files", "__files"), "conversation_id", "left").withColumnRenamed("conversation_id", "id")
    out = conversations.join(fresh, "id", "left")
    known = F.col("__prompts").isNotNull()
    columns = {
        "started_at": F.when(F.col("started_at") == 0, F.coalesce("__start", "started_at")).otherwise(F.least("started_at", "__start")),
        "ended_at": F.greatest("ended_at", "__end"),
        "user_prompt_count": F.coalesce("__prompts", "user_prompt_count"),
        "files_edited": F.when(known, F.coalesce("__files", F.lit(""))).otherwise(F.col("files_edited")),
    }
    return out.withColumns(columns).select(conversations.columns)


def top_ratings(ratings: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ratings; a limit out of 1 to 500 is 50."""
    return ratings.orderBy(F.desc("created_at"), F.desc("seq")).limit(limit if 0 < limit <= 500 else 50)


def first_conversations(conversations: DataFrame, limit: int = 100) -> DataFrame:
    """Conversations by id; a limit out of 1 to 500 is 100."""
    return conversations.orderBy("id").limit(limit if 0 < limit <= 500 else 100)


def _with_path(conversations: DataFrame, projects: DataFrame, agent: str, blank: str) -> DataFrame:
    own = conversations.filter((F.col("agent") == agent) & (F.coalesce(F.col(blank).cast("string"), F.lit("")) == ""))
    return own.join(projects.select(F.col("id").alias("project_id"), "path"), "project_id").select("id", "path")


def untitled(conversations: DataFrame, projects: DataFrame, agent: str) -> DataFrame:
    """(id, path) of an agent's conversations without a title, with their project's path."""
    return _with_path(conversations, projects, agent, "title")


def parentless(conversations: DataFrame, projects: DataFrame, agent: str) -> DataFrame:
    """(id, path) of an agent's conversations without a parent, with their project's path."""
    return _with_path(conversations, projects, agent, "parent_conversation_id")


DETAIL_TYPES = ("prompt", "final_answer", "answer", "question", "diff")


def batch_detail(messages: DataFrame, ids: DataFrame, commands: tuple[str, ...] = RATING_COMMANDS) -> DataFrame:
    """What a list of conversations (id) shows of its messages: prompts that aren't rating commands, questions, answers and diffs, oldest first."""
    own = messages.filter(F.col("message_type").isin(*DETAIL_TYPES)).join(ids.select(F.col("id").alias("conversation_id")).distinct(), "conversation_id", "left_semi")
    return own.filter(~((F.col("message_type") == "prompt") & is_rating_command(F.col("content"), commands))).orderBy("timestamp", "id")


def visible_messages(messages: DataFrame, matched: DataFrame) -> DataFrame:
    """Messages that a conversation shows: not the blank ones, nor the commands that a rating was matched with (message_id)."""
    return messages.filter(visible(F.col("content"))).join(matched.select(F.col("message_id").alias("id")), "id", "left_anti")


def agent_diffs(messages: DataFrame, conversations: DataFrame, start: int, end: int) -> DataFrame:
    """Agents' diff messages of [start, end], both ends included, with the title and agent of their conversations, hidden ones left out; by time, then id."""
    own = messages.filter((F.col("role") == "agent") & (F.col("message_type") == "diff") & F.col("timestamp").between(start, end))
    shown = conversations.filter(~F.col("hidden")).select(F.col("id").alias("conversation_id"), "title", "agent")
    return own.join(shown, "conversation_id").orderBy("timestamp", "id")


def contributions(matched: DataFrame, messages: DataFrame) -> DataFrame:
    """(commit_id, message_id, lines, timestamp): messages that gave a commit lines, oldest first in each commit."""
    lines = matched.groupBy("commit_id", "message_id").agg(F.count(F.lit(1)).alias("lines"))
    times = messages.select(F.col("message_id") if "message_id" in messages.columns else F.col("id").alias("message_id"), "timestamp").dropDuplicates(["message_id"])
    return lines.join(times, "message_id").select("commit_id", "message_id", "lines", "timestamp").orderBy("commit_id", "timestamp", "message_id")


def timeline(messages: DataFrame, standalone: tuple[str, ...] = ("prompt", "answer", "final_answer")) -> DataFrame:
    """(conversation_id, run, kind, first_at, last_at, n): a conversation's entries: standalone messages alone, others as groups of a run.

    Prompts go one second back, so that they come before what they cause; questions,
    which their answers repeat, are left out. Consecutive diffs make a group of their own.
    """
    shown = messages.filter("message_type != 'question'").withColumn("at", F.col("timestamp") - F.when(F.col("message_type") == "prompt", 1000).otherwise(0))
    kind = F.when(F.col("message_type").isin(*standalone), F.col("message_type")).when(F.col("message_type") == "diff", "diffs").otherwise("logs")
    order = W.partitionBy("conversation_id").orderBy("at", "id")
    rows = shown.withColumn("kind", kind)
    fresh = F.col("kind").isin(*standalone) | ~F.lag("kind").over(order).eqNullSafe(F.col("kind"))
    runs = rows.withColumn("run", F.sum(fresh.cast("long")).over(order))
    return runs.groupBy("conversation_id", "run").agg(F.min("kind").alias("kind"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n"))


def session_by_rating(history: DataFrame, asked: DataFrame, window_ms: int = 30_000) -> DataFrame:
    """(request, session_id): the session in which a rating and note was typed last, at most window_ms before the request.

    history: (session_id, timestamp, rating, note); asked: (request, at, rating, note, thread_id); a known thread is taken as it is.
    """
    known = asked.filter(F.coalesce("thread_id", F.lit("")) != "").select("request", F.col("thread_id").alias("session_id"))
    typed = history.select("session_id", "timestamp", "rating", F.trim("note").alias("note"), F.explode(F.array(*[F.floor(F.col("timestamp") / window_ms) + i for i in (0, 1)])).alias("bin"))
    rest = asked.filter(F.coalesce("thread_id", F.lit("")) == "").select("request", "at", "rating", F.trim("note").alias("note"), F.floor(F.col("at") / window_ms).alias("bin"))
    near = rest.join(typed, ["rating", "note", "bin"]).filter((F.col("timestamp") <= F.col("at")) & (F.col("timestamp") >= F.col("at") - window_ms))
    return known.unionByName(near.groupBy("request").agg(F.max_by("session_id", F.struct("timestamp", "session_id")).alias("session_id")))
