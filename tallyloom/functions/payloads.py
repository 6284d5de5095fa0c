"""What raw JSON payloads of messages say: model, questions and answers, tools, snapshots of files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.messages import canonical_type, is_system
from .diffs import edit_diff, json_diffs

# Keys that name a model, and the tool by which agents ask.
MODEL_KEYS = ("model", "modelName", "model_name", "model_slug", "modelSlug")
ASK_TOOL = "AskUserQuestion"
DERIVED_DIFF = '{"source":"derived_diff"}'
SESSION_PATH = r"/([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})(?:\.jsonl|\b)"


def _loads(raw: str | None):
    try:
        return json.loads(raw or "null")
    except ValueError:
        return None


def find_model(value) -> str:
    """The first non-blank model name at any depth, objects by sorted key."""
    if isinstance(value, dict):
        for key in MODEL_KEYS:
            if isinstance(value.get(key), str) and value[key].strip():
                return value[key].strip()
        value = [value[k] for k in sorted(value)]
    if isinstance(value, list):
        return next((m for m in map(find_model, value) if m), "")
    return ""


@F.pandas_udf(T.StringType())
def model_column(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: find_model(_loads(r)))


def _blocks(root) -> list[dict]:
    content = ((root or {}).get("message") or {}).get("content") if isinstance(root, dict) else None
    return [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def questions_of(raw: str | None) -> list[dict]:
    return [q for b in _blocks(_loads(raw)) if b.get("type") == "tool_use" and b.get("name") == ASK_TOOL for q in (b.get("input") or {}).get("questions") or []]


def _option(option) -> tuple[str, str]:
    return (str(option.get("label") or "").strip(), str(option.get("description") or "").strip()) if isinstance(option, dict) else (str(option).strip(), "")


def _described(label: str, description: str) -> str:
    return ": ".join(x for x in (f"**{label}**" if label else "", description) if x)


def question_markdown(questions: list[dict]) -> str:
    """Questions with header and options."""
    out = []
    for q in questions:
        lines = [f"### {q['header'].strip()}"] if (q.get("header") or "").strip() else []
        lines.append((q.get("question") or "").strip())
        options = [_described(*_option(o)) for o in q.get("options") or [] if any(_option(o))]
        out.append("\n".join(lines + (["", "Options:", *(f"- {o}" for o in options)] if options else [])))
    return "\n\n".join(out).strip()


def answer_markdown(questions: list[dict], answers: dict) -> str:
    """Questions with what was chosen of their options, and answers of one's own."""
    out = []
    for q in questions:
        given = answers.get(q.get("id") or q.get("question"))
        given = [g.strip() for g in (given if isinstance(given, list) else str(given or "").split(",")) if g and g.strip()]
        options = [_option(o) for o in q.get("options") or []]
        labels = {label for label, _ in options}
        lines = [f"### {q['header'].strip()}"] if (q.get("header") or "").strip() else []
        lines.append("Question: " + (q.get("question") or "").strip())
        if options:
            lines += ["", *(f"- [{'x' if label in given else ' '}] {_described(label, description)}" for label, description in options)]
        own = [g.removeprefix("user_note:").strip() for g in given if g not in labels]
        lines += ["", "Custom:", *(f"- {g}" for g in own)] if own else []
        out.append("\n".join(lines))
    return "\n\n".join(out).strip()


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("role", "message_type", "content")]))
def classify_payload(role: pd.Series, content: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """Questions, answers and final answers by their payload; a null type leaves the choice to the text."""
    out = []
    for r, c, j in zip(role, content, raw, strict=True):
        root = _loads(j)
        asked = questions_of(j)
        result = root.get("toolUseResult") if isinstance(root, dict) else None
        if asked:
            out.append(("agent", "question", question_markdown(asked)))
        elif isinstance(result, dict) and isinstance(result.get("answers"), dict):
            out.append(("user", "answer", answer_markdown(result.get("questions") or [], result["answers"])))
        elif r == "agent" and isinstance(root, dict) and ((root.get("message") or {}).get("stop_reason") == "end_turn") and (c or "").strip():
            out.append((r, "final_answer", c))
        else:
            out.append((r, None, c))
    return pd.DataFrame(out, columns=["role", "message_type", "content"])


def classified(messages: DataFrame) -> DataFrame:
    """messages with role, type and content as their payload has them, else as their text suggests."""
    rows = messages.withColumn("__p", classify_payload("role", "content", "raw_json"))
    kind = F.coalesce("__p.message_type", canonical_type(F.col("__p.role"), F.col("message_type"), F.col("__p.content")))
    return rows.withColumns({"message_type": kind, "role": F.col("__p.role"), "content": F.col("__p.content")}).drop("__p")


def tool_summary(names: Column) -> Column:
    """[A, B] of the distinct names of an array of tools; '' if there are none."""
    kept = F.array_distinct(F.filter(names, lambda n: F.trim(n) != ""))
    return F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))).otherwise("")


def models_seen(messages: DataFrame) -> DataFrame:
    """(conversation_id, models) in order of first use."""
    first = messages.filter(F.trim("model") != "").groupBy("conversation_id", "model").agg(F.min(F.struct("timestamp", "id")).alias("seen"))
    return first.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "model"))), lambda x: x["model"]).alias("models"))


def parents_from_prompts(messages: DataFrame) -> DataFrame:
    """(conversation_id, parent_conversation_id): a session file named in a conversation's first substantive user message."""
    said = messages.filter((F.col("role") == "user") & (F.trim("content") != "") & ~is_system(F.col("content")))
    first = said.withColumn("n", F.row_number().over(W.partitionBy("conversation_id").orderBy("timestamp", "id"))).filter("n = 1")
    found = first.select("conversation_id", F.regexp_extract("content", SESSION_PATH, 1).alias("parent_conversation_id"))
    return found.filter("parent_conversation_id != '' AND parent_conversation_id != conversation_id")


def substantive(messages: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """Messages of conversations that have a user message or a rating."""
    kept = messages.filter("role = 'user'").select("conversation_id")
    if ratings is not None:
        kept = kept.union(ratings.select("conversation_id"))
    return messages.join(kept.distinct(), "conversation_id", "left_semi")


def snapshot_diffs(snapshots: DataFrame) -> DataFrame:
    """(conversation_id, timestamp, path, diff): whole-file writes against the original, else what the conversation wrote there before.

    snapshots: (conversation_id, timestamp, id, path, original, content, is_create).
    """
    w = W.partitionBy("conversation_id", "path").orderBy("timestamp", "id")
    rows = snapshots.withColumn("before", F.coalesce(F.nullif("original", F.lit("")), F.lag("content").over(w), F.when(F.col("is_create"), "")))

    @F.pandas_udf(T.StringType())
    def diff(path: pd.Series, before: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([edit_diff(p, (b or "").replace("\r\n", "\n"), c or "") for p, b, c in zip(path, before, content, strict=True)])

    return rows.filter("before IS NOT NULL").select("conversation_id", "timestamp", "path", diff("path", "before", "content").alias("diff")).filter("diff != ''")


def with_derived_diffs(messages: DataFrame) -> DataFrame:
    """messages and, after each, the diffs of its payload as diff messages at free milliseconds; a diff counts once in a conversation and role."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(raw: pd.Series) -> pd.Series:
        return raw.map(json_diffs)

    each = messages.select("*", F.posexplode(found("raw_json")).alias("nth", "diff"))
    once = each.withColumn("n", F.row_number().over(W.partitionBy("conversation_id", "role", "diff").orderBy("timestamp", "id", "nth"))).filter("n = 1")
    derived = once.withColumns(
        {"content": F.concat(F.lit("```diff\n"), "diff", F.lit("\n```")), "message_type": F.lit("diff"), "raw_json": F.lit(DERIVED_DIFF), "id": F.concat_ws("-", "id", F.lit("diff"), "nth")}
    )
    # Times that no message has are numbered in order: time t has the number t less the message times before it. A
    # derived row wants the first free number after its source, takes the next one not taken, and is turned back into
    # a time by counting the message times below; three windows, no loop over times.
    conversation = W.partitionBy("conversation_id")
    ranked = messages.select("conversation_id", "timestamp").distinct().withColumn("rank", F.row_number().over(conversation.orderBy("timestamp")).cast("long"))
    wanted = derived.join(ranked, ["conversation_id", "timestamp"]).withColumn("free", F.col("timestamp") + 1 - F.col("rank"))
    order = conversation.orderBy("free", "timestamp", "id")
    wanted = wanted.withColumn("i", F.row_number().over(order).cast("long"))
    wanted = wanted.withColumn("free", F.max(F.col("free") - F.col("i")).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("i"))
    marks = ranked.select("conversation_id", (F.col("timestamp") - F.col("rank")).alias("free"), F.lit(1).alias("taken"))
    both = wanted.select(*[c for c in messages.columns], "free", F.lit(0).alias("taken")).unionByName(marks, allowMissingColumns=True)
    below = F.sum("taken").over(conversation.orderBy("free", "taken").rowsBetween(W.unboundedPreceding, 0))
    placed = both.withColumn("timestamp", F.col("free") + below).filter("taken = 0")
    return messages.unionByName(placed.select(messages.columns))


def is_meta(raw: Column) -> Column:
    """Whether a payload is marked as meta."""
    return F.coalesce(F.get_json_object(raw, "$.isMeta") == "true", F.lit(False))


# Payload keys that say most of an event without text, in order.
EVENT_KEYS = ("name", "command", "status", "message", "text")


def event_label(kind: Column, payload: Column) -> Column:
    """[type:subtype] and the first value that a payload has of EVENT_KEYS."""
    value = F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, f"$.{key}")), F.lit("")) for key in EVENT_KEYS], F.lit(""))
    label = F.concat(F.lit("["), kind, F.lit(":"), F.coalesce(F.get_json_object(payload, "$.type"), F.lit("")), F.lit("]"))
    return F.trim(F.concat(label, F.lit(" "), value))


def with_cwd(raw: Column, cwd: Column) -> Column:
    """A JSON object with its folder put in, if it has none; other texts stay."""
    inner = F.regexp_replace(F.trim(raw), r"^\{", "")
    put = F.concat(F.lit('{"cwd":'), F.to_json(F.struct(cwd.alias("c"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(cwd.alias("c")))) - 6), F.when(F.trim(inner) == "}", "").otherwise(","), inner)
    return F.when(F.trim(raw).startswith("{") & F.get_json_object(raw, "$.cwd").isNull(), put).otherwise(raw)


def json_texts(value: Column, path: str, separator: str = "\n") -> Column:
    """The texts of an array at a path of a JSON value, joined; '' if there is none."""
    items = F.from_json(F.get_json_object(value, path), "array<struct<text:string>>")
    return F.coalesce(F.array_join(F.filter(F.transform(items, lambda x: x["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), separator), F.lit(""))


def folder_of_tool(directories: Column, args: Column, keys: tuple[str, ...] = ("file_path", "path", "dir_path", "directory")) -> Column:
    """The first absolute directory, else the first absolute path among a tool's arguments, in the order of `keys`."""
    absolute = F.get(F.filter(directories, lambda d: d.startswith("/")), F.lit(0))
    named = [F.get_json_object(args, f"$.{key}") for key in keys]
    return F.coalesce(absolute, *[F.when(v.startswith("/"), v) for v in named])
