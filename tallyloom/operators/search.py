"""Substring search over prompts and commits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a token needs to be looked up by itself; shorter ones are ignored beside longer ones.
TOKEN_CHARS = 3


def contains(columns: list[Column], term: str, mode: str = "phrase") -> Column:
    """phrase: the trimmed term as one substring; all_tokens: every token of three or more characters somewhere in
    the row, or the phrase if there is none. Case doesn't count."""
    folded = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    term = " ".join(term.split()) if mode == "all_tokens" else term.strip()
    words = [t for t in term.lower().split() if len(t) >= TOKEN_CHARS] if mode == "all_tokens" else []
    if not term:
        return F.lit(False)

    def somewhere(piece: str) -> Column:
        return reduce(lambda a, b: a | b, [c.contains(piece) for c in folded])

    return reduce(lambda a, b: a & b, [somewhere(w) for w in words]) if words else somewhere(term.lower())


def search_messages(messages: DataFrame, conversations: DataFrame, term: str, mode: str = "phrase") -> DataFrame:
    """Prompts of shown conversations that hold the term."""
    shown = conversations.filter(~F.col("hidden")).select(F.col("id").alias("conversation_id"))
    return messages.filter((F.col("message_type") == "prompt") & contains([F.col("content")], term, mode)).join(shown, "conversation_id", "left_semi")


def search_commits(commits: DataFrame, term: str, mode: str = "phrase") -> DataFrame:
    """Commits by hash and subject; the phrase mode reads the diff text too."""
    columns = ["commit_hash", "subject", *(["diff_content"] if mode == "phrase" and "diff_content" in commits.columns else [])]
    return commits.filter(contains([F.col(c) for c in columns], term, mode))


def search_projects(projects: DataFrame, hits: DataFrame, commit_hits: DataFrame) -> DataFrame:
    """Projects with hits, most first, then by label. hits: (project_id, conversation_id); commit_hits: (project_id, commit_hash)."""
    a = hits.groupBy("project_id").agg(F.countDistinct("conversation_id").alias("conversation_matches"))
    b = commit_hits.groupBy("project_id").agg(F.countDistinct("commit_hash").alias("commit_matches"))
    counts = a.join(b, "project_id", "full").fillna(0, ["conversation_matches", "commit_matches"]).withColumnRenamed("project_id", "id")
    out = projects.filter(~F.col("ignored")).join(counts, "id").filter("conversation_matches + commit_matches > 0")
    return out.select("id", "label", "conversation_matches", "commit_matches").orderBy(F.desc(F.col("conversation_matches") + F.col("commit_matches")), F.lower("label"), "id")


def trigram_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(trigram, key): an inverted index for repeated searches; a search semi-joins on the trigrams of its term and then verifies."""
    grams = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))  # overlapping, in one pass
    return rows.select(key, F.explode(grams).alias("trigram"))
