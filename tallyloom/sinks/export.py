"""Sinks: partition replacement, append-only logs and a Markdown export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows over those partitions of a table that they hold, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def markdown(commits: DataFrame, links: DataFrame, prompts: DataFrame, newest_first: bool = True) -> DataFrame:
    """(commit_id, authored_at, section): a Markdown section for each commit with its linked prompts, oldest prompt first.

    prompts: (conversation_id, timestamp, content). Order the sections by authored_at.
    """
    met = links.join(prompts, "conversation_id").groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "content"))).alias("prompts"))
    joined = commits.select(F.col("id").alias("commit_id"), "commit_hash", "subject", "authored_at").join(met, "commit_id", "left")
    quoted = F.transform(F.coalesce("prompts", F.array().cast("array<struct<timestamp:bigint,content:string>>")), lambda p: _quoted(p["content"]))
    head = F.concat(F.lit("## "), "subject", F.lit(" (`"), F.substring("commit_hash", 1, 8), F.lit("`)\n\n"))
    order = F.desc("authored_at") if newest_first else F.asc("authored_at")
    return joined.select("commit_id", "authored_at", F.concat(head, F.array_join(quoted, "\n\n")).alias("section")).orderBy(order, "commit_id")


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))


def prompts_markdown(conversations: DataFrame, prompts: DataFrame, links: DataFrame, commits: DataFrame, newest_first: bool = True) -> DataFrame:
    """(conversation_id, started_at, section): a Markdown section for each conversation: its prompts, oldest first, then the commits linked with it.

    conversations: (id, title, started_at); prompts: (conversation_id, timestamp, content). Order the sections by started_at.
    """
    said = prompts.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "content"))).alias("prompts"))
    own = commits.select(F.col("id").alias("commit_id"), "commit_hash", "subject", "authored_at")
    made = links.join(own, "commit_id").groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("authored_at", "commit_hash", "subject"))).alias("commits"))
    joined = conversations.select(F.col("id").alias("conversation_id"), "title", "started_at").join(said, "conversation_id", "left").join(made, "conversation_id", "left")
    lines = F.coalesce(F.transform("commits", lambda c: F.concat(F.lit("- `"), F.substring(c["commit_hash"], 1, 8), F.lit("` "), c["subject"])), F.array().cast("array<string>"))
    texts = F.coalesce(F.transform("prompts", lambda p: _quoted(p["content"])), F.array().cast("array<string>"))
    section = F.concat(F.lit("## "), "title", F.lit("\n\n"), F.array_join(texts, "\n\n"), F.when(F.size(lines) > 0, F.lit("\n\n")).otherwise(""), F.array_join(lines, "\n"))
    order = F.desc("started_at") if newest_first else F.asc("started_at")
    return joined.select("conversation_id", "started_at", section.alias("section")).orderBy(order, "conversation_id")


def escaped_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def html_sections(commits: DataFrame, links: DataFrame, prompts: DataFrame) -> DataFrame:
    """(commit_id, authored_at, section): an HTML section for each commit with its linked prompts, oldest first."""
    met = links.join(prompts, "conversation_id").groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "content"))).alias("prompts"))
    joined = commits.select(F.col("id").alias("commit_id"), "subject", "authored_at").join(met, "commit_id", "left")
    quotes = F.coalesce(F.transform("prompts", lambda p: F.concat(F.lit("<blockquote>"), F.replace(escaped_html(p["content"]), F.lit("\n"), F.lit("<br>")), F.lit("</blockquote>"))), F.array().cast("array<string>"))
    return joined.select("commit_id", "authored_at", F.concat(F.lit("<section><h2>"), escaped_html(F.col("subject")), F.lit("</h2>"), F.array_join(quotes, ""), F.lit("</section>")).alias("section")).orderBy("authored_at", "commit_id")


def nested_export(links: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(commit_id, conversations): each commit's conversations by start, each an id, a title and its messages by time.

    What is nested goes once through the shuffle for each set of conversations that
    commits have, not for each link: commits join it by their set.
    """
    said = messages.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id", "message_type", "content"))).alias("messages"))
    own = conversations.select(F.col("id").alias("conversation_id"), "title", "started_at").join(said, "conversation_id", "left")
    each = F.struct("started_at", "conversation_id", "title", F.coalesce("messages", F.array().cast(said.schema["messages"].dataType)).alias("messages"))
    known = links.join(conversations.select(F.col("id").alias("conversation_id")), "conversation_id", "left_semi")
    sets = known.groupBy("commit_id").agg(F.array_sort(F.collect_list("conversation_id")).alias("set"))
    nested = sets.select("set").distinct().select("set", F.explode("set").alias("conversation_id")).join(own, "conversation_id")
    nested = nested.groupBy("set").agg(F.array_sort(F.collect_list(each)).alias("conversations"))
    return sets.join(nested, "set").select("commit_id", "conversations")
