"""Transcripts of four kinds of coding agents as message rows.

Columns of every reader: session_id, cwd, timestamp (ms), role, model, content, raw_json, source_file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import epoch_ms, own_home, within

MESSAGE = ("session_id", "cwd", "timestamp", "role", "model", "content", "raw_json", "source_file")


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Lines (value, source_file) of all files below a folder, as a batch or a stream of new files."""
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", True)
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("source_file"))


def json_text(value: Column, path: str) -> Column:
    return F.get_json_object(value, path)


def content_text(content: Column) -> Column:
    """The text of a content value: a string, or an array of strings and text blocks, distinct and newline-joined."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(parts, lambda p: F.coalesce(F.when(~p.startswith("{"), p), F.get_json_object(p, "$.text"), F.get_json_object(p, "$.content"), F.lit("")))
    joined = F.array_join(F.array_distinct(F.filter(texts, lambda t: F.trim(t) != "")), "\n")
    return F.when(content.startswith("["), joined).otherwise(F.coalesce(content, F.lit("")))


def session_lines(lines: DataFrame) -> DataFrame:
    """Session files with a JSON object a line: lines without session, folder or time are dropped; a line's own
    type stands in for a missing role, and for missing text in brackets."""
    v = F.col("value")
    kind, content = json_text(v, "$.type"), content_text(json_text(v, "$.message.content"))
    side = (json_text(v, "$.isSidechain") == "true") & (json_text(v, "$.userType") == "external") & json_text(v, "$.agentId").isNotNull()
    role = F.coalesce(json_text(v, "$.message.role"), kind, F.lit("user"))
    role = F.when(F.coalesce(side, F.lit(False)) | (role == "assistant") | json_text(v, "$.sourceToolAssistantUUID").isNotNull(), "agent").when(role == "user", "user").otherwise("agent")
    out = lines.select(
        json_text(v, "$.sessionId").alias("session_id"),
        json_text(v, "$.cwd").alias("cwd"),
        epoch_ms(json_text(v, "$.timestamp")).alias("timestamp"),
        role.alias("role"),
        F.coalesce(json_text(v, "$.message.model"), F.lit("")).alias("model"),
        F.when(content != "", content).otherwise(F.concat(F.lit("["), F.coalesce(kind, F.lit("user")), F.lit("]"))).alias("content"),
        v.alias("raw_json"),
        "source_file",
    )
    return out.filter("session_id != '' AND cwd != '' AND timestamp IS NOT NULL")


def summaries(lines: DataFrame) -> DataFrame:
    """(source_file, leaf, title) of summary lines."""
    v = F.col("value")
    return lines.filter(json_text(v, "$.type") == "summary").select("source_file", json_text(v, "$.leafUuid").alias("leaf"), json_text(v, "$.summary").alias("title"))


def history_lines(lines: DataFrame) -> DataFrame:
    """The shared history file: what a user typed, with pasted texts put in place of their marks."""
    v = F.col("value")
    pasted = F.from_json(json_text(v, "$.pastedContents"), "map<string,struct<id:int,content:string>>")
    display = json_text(v, "$.display")
    filled = F.aggregate(
        F.map_values(pasted), display, lambda text, p: F.replace(text, F.regexp_extract(text, r"(\[Pasted text #\d+[^\]]*\])", 1), F.coalesce(p["content"], F.lit("")))
    )
    return lines.select(
        json_text(v, "$.sessionId").alias("session_id"), json_text(v, "$.project").alias("cwd"), epoch_ms(json_text(v, "$.timestamp")).alias("timestamp"), F.lit("user").alias("role"),
        F.lit("").alias("model"), F.coalesce(filled, display).alias("content"), v.alias("raw_json"), "source_file",
    ).filter("content IS NOT NULL AND timestamp IS NOT NULL")


def fill_times(rows: DataFrame, session: str = "source_file", order: str = "line") -> DataFrame:
    """Missing times: the last known one and 1 ms more for each line since."""
    w = W.partitionBy(session).orderBy(order)
    known = F.when(F.col("timestamp").isNotNull(), F.col(order))
    back = w.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("timestamp", F.coalesce("timestamp", F.last("timestamp", True).over(back) + (F.col(order) - F.last(known, True).over(back))))


def rollout_thread(file: Column) -> Column:
    """The thread of rollout-<n>-<thread>.jsonl, else the base name."""
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.jsonl$", "")
    found = F.regexp_extract(name, r"^rollout-[^-]+-(.+)$", 1)
    return F.when(found != "", found).otherwise(name)


def rollouts(lines: DataFrame) -> DataFrame:
    """Rollout files: typed events whose model and folder hold until changed. lines: (value, source_file, line)."""
    v = F.col("value")
    kind, payload = json_text(v, "$.type"), json_text(v, "$.payload.type")
    w = W.partitionBy("source_file").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = lines.withColumns(
        {
            "cwd": F.last(F.coalesce(json_text(v, "$.payload.cwd"), json_text(v, "$.payload.working_dir"), json_text(v, "$.cwd")), True).over(w),
            "model": F.coalesce(F.last(F.coalesce(json_text(v, "$.payload.model"), json_text(v, "$.model")), True).over(w), F.lit("")),
            "own": F.first(json_text(v, "$.payload.id"), True).over(W.partitionBy("source_file")),
        }
    )
    text = content_text(F.coalesce(json_text(v, "$.payload.content"), json_text(v, "$.payload.message"), json_text(v, "$.item.content"), json_text(v, "$.text")))
    label = F.concat(F.lit("["), kind, F.lit(":"), F.coalesce(payload, F.lit("")), F.lit("]"))
    said = F.coalesce(json_text(v, "$.payload.role"), json_text(v, "$.item.role"), F.when(kind == "input", "user"), F.when(payload == "user_message", "user"), F.lit("assistant"))
    out = rows.filter(kind.isin("response_item", "event_msg", "input", "item.completed")).select(
        F.coalesce("own", rollout_thread(F.col("source_file"))).alias("session_id"), F.coalesce("cwd", F.lit("")).alias("cwd"), epoch_ms(json_text(v, "$.timestamp")).alias("timestamp"),
        F.when(said == "user", "user").otherwise("agent").alias("role"), "model", F.when(text != "", text).otherwise(label).alias("content"), v.alias("raw_json"), "source_file",
    )
    return out.filter("timestamp IS NOT NULL")


SESSION_JSON = "sessionId string, projectHash string, model string, messages array<struct<id:string,timestamp:string,type:string,content:string,displayContent:string,model:string>>, directories array<string>"


def session_documents(files: DataFrame) -> DataFrame:
    """Whole-file JSON sessions. files: (value, source_file), one row a file."""
    d = files.select("source_file", F.from_json("value", SESSION_JSON).alias("d")).select("source_file", "d.*")
    m = F.col("m")
    return d.select("*", F.explode("messages").alias("m")).select(
        F.col("sessionId").alias("session_id"), F.coalesce(F.get("directories", F.lit(0)), F.lit("")).alias("cwd"), epoch_ms(m["timestamp"]).alias("timestamp"),
        F.when(m["type"] == "user", "user").otherwise("agent").alias("role"), F.coalesce(m["model"], "model", F.lit("")).alias("model"),
        F.coalesce(m["displayContent"], content_text(m["content"]), F.lit("")).alias("content"), F.to_json("m").alias("raw_json"), "source_file",
    ).filter("timestamp > 0")


COMPOSER = "composerId string, name string, createdAt long, conversation array<struct<bubbleId:string,type:int,text:string,timingInfo:struct<clientStartTime:long>>>, fullConversationHeadersOnly array<struct<bubbleId:string,type:int>>"


def composers(entries: DataFrame) -> DataFrame:
    """Key-value entries (key, value): conversations inline, or as headers whose bubbles are entries of their own."""
    data = entries.filter(F.col("key").startswith("composerData:")).select(F.from_json("value", COMPOSER).alias("d")).select("d.*")
    inline = data.filter(F.size("conversation") > 0).select("composerId", "name", "createdAt", F.posexplode("conversation").alias("at", "b"))
    inline = inline.select("composerId", "name", "createdAt", "at", "b.bubbleId", "b.type", "b.text", F.col("b.timingInfo.clientStartTime").alias("timestamp"))
    heads = data.filter(F.coalesce(F.size("conversation"), F.lit(0)) < 1).select("composerId", "name", "createdAt", F.posexplode("fullConversationHeadersOnly").alias("at", "h"))
    bubbles = entries.filter(F.col("key").startswith("bubbleId:")).select(
        F.split("key", ":")[1].alias("composerId"), F.split("key", ":")[2].alias("bubbleId"), json_text(F.col("value"), "$.text").alias("text"), json_text(F.col("value"), "$.timingInfo.clientStartTime").cast("long").alias("timestamp")
    )
    looked_up = heads.select("composerId", "name", "createdAt", "at", "h.bubbleId", "h.type").join(bubbles, ["composerId", "bubbleId"]).select(inline.columns)
    return inline.unionByName(looked_up)


def cloud_events(files: DataFrame) -> DataFrame:
    """Exported arrays of events: one message an event, model and folder from the init event."""
    events = files.select("source_file", F.posexplode(F.from_json("value", "array<string>")).alias("line", "value"))
    v = F.col("value")
    w = W.partitionBy("source_file")
    rows = events.withColumns({"session_id": F.first(json_text(v, "$.session_id"), True).over(w), "cwd": F.first(json_text(v, "$.cwd"), True).over(w), "m": F.first(json_text(v, "$.model"), True).over(w)})
    content = content_text(json_text(v, "$.message.content"))
    return rows.filter(json_text(v, "$.type").isin("user", "assistant") & (content != "")).select(
        "session_id", F.coalesce("cwd", F.lit("")).alias("cwd"), epoch_ms(F.coalesce(json_text(v, "$.created_at"), json_text(v, "$.timestamp"))).alias("timestamp"),
        F.when(json_text(v, "$.type") == "user", "user").otherwise("agent").alias("role"), F.coalesce(json_text(v, "$.message.model"), "m", F.lit("")).alias("model"), content.alias("content"), v.alias("raw_json"), "source_file",
    )


TURNS = "map<string,struct<created_at:string,role:string,input_items:array<struct<type:string,text:string,content:string>>,output_items:array<struct<type:string,text:string,content:string>>>>"


def cloud_tasks(files: DataFrame) -> DataFrame:
    """Exported maps of turns: items in order of turns, each 1 ms after the one before in its turn."""
    turns = files.select("source_file", F.explode(F.from_json(json_text(F.col("value"), "$.turns"), TURNS)).alias("turn_id", "t"))
    items = F.concat(F.coalesce("t.input_items", F.array().cast("array<struct<type:string,text:string,content:string>>")), F.coalesce("t.output_items", F.array().cast("array<struct<type:string,text:string,content:string>>")))
    each = turns.select("source_file", "turn_id", "t", F.posexplode(items).alias("at", "i"), F.size(F.coalesce("t.input_items", F.array())).alias("inputs"))
    return each.select(
        F.regexp_extract("source_file", r"([^/]+?)(?:\.json)?$", 1).alias("session_id"), F.lit("").alias("cwd"), (epoch_ms(F.col("t.created_at")) + F.col("at")).alias("timestamp"),
        F.when(F.col("at") < F.col("inputs"), "user").otherwise("agent").alias("role"), F.lit("").alias("model"), F.coalesce("i.text", content_text(F.col("i.content")), F.lit("")).alias("content"), F.to_json("i").alias("raw_json"), "source_file",
    ).filter("content != ''")


def without_duplicates(history: DataFrame, files: DataFrame) -> DataFrame:
    """Both sources, a history row only if the session's file has no row of its role and content."""
    return files.unionByName(history.join(files.select("session_id", "role", "content").distinct(), ["session_id", "role", "content"], "left_anti").select(files.columns))


def web_conversation(rows: DataFrame, now_ms: int) -> DataFrame:
    """Messages posted by a browser: roles user and agent only, a time of 0 is now."""
    return rows.filter(F.col("role").isin("user", "agent")).withColumn("timestamp", F.when(F.coalesce("timestamp", F.lit(0)) == 0, now_ms).otherwise(F.col("timestamp")))


def latest_session(history: DataFrame, rating: int, note: str, since_ms: int) -> DataFrame:
    """The newest session in which a rating of that note was typed since a time."""
    hit = history.filter((F.col("timestamp") >= since_ms) & (F.col("rating") == rating) & (F.trim("note") == note.strip()))
    return hit.agg(F.max_by("session_id", "timestamp").alias("session_id")).filter("session_id IS NOT NULL")


def rescanned(rows: DataFrame, since_ms: int, folders: list[str] | None = None, foreign: str | None = None, home: str = "") -> DataFrame:
    """Messages of a rescan of histories: since a time, in some folders or all, with folders of a mounted home mapped to the own one."""
    kept = rows.filter(F.col("timestamp") >= since_ms)
    if foreign is not None:
        kept = kept.withColumn("cwd", own_home(F.col("cwd"), foreign, home))
    return kept.filter(within(F.col("cwd"), folders))
