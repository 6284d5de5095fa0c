"""Entry points that a service over this engine calls, each returning DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, commits, conversations, search
from ..session import stored


def commits_page(rows: DataFrame, coverage: DataFrame, branch: str, size: int = 20, number: int = 1, emails: list[str] | None = None, start: int = 0, end: int = 0, agent: str | None = None, term: str | None = None) -> dict[str, DataFrame]:
    """A page of a branch's commits with their count, agents and summary, under optional filters."""
    kept = commits.filter_commits(rows, branch, emails=emails, start=start, end=end)
    if term:
        kept = search.search_commits(kept, term)
    if agent:
        kept = commits.by_agent(kept, coverage, agent)
    return {
        "page": commits.page(kept, size, number),
        "count": kept.agg(F.count(F.lit(1)).alias("n_commits")),
        "summary": commits.commit_summary(kept, coverage, "branch_name"),
        "agents": commits.agent_summary(kept, coverage, "branch_name"),
    }


#: Commits of a branch, newest first, that a search looks at.
SEARCHED = 10_000


def found_commits(rows: DataFrame, branch: str, term: str, size: int = 20, number: int = 1, emails: list[str] | DataFrame | None = None) -> dict[str, DataFrame]:
    """A page of a branch's commits that hold the term, under a user filter, and their count before it; of a branch the newest SEARCHED are looked at.

    emails: a list, or a table (user_email) if they are many.
    """
    found = search.search_commits(commits.newest(commits.filter_commits(rows, branch), SEARCHED), term)
    if isinstance(emails, DataFrame):
        folded = F.lower(F.trim("user_email")).alias("__email")
        mine = found.withColumn("__email", folded).join(emails.select(folded), "__email", "left_semi").drop("__email")
    else:
        mine = commits.filter_commits(found, branch, emails=emails)
    return {"page": commits.page(mine, size, number), "count": found.agg(F.count(F.lit(1)).alias("n_commits"))}


def project_page(convs: DataFrame, messages: DataFrame, ratings: DataFrame, size: int = 20, number: int = 1, term: str | None = None, under_five: bool = False, start: int = 0, end: int = 0) -> DataFrame:
    """A page of conversation families of which a member meets all filters."""
    matching = convs
    if term:
        hits = search.search_messages(messages, convs, term).select(F.col("conversation_id").alias("id"))
        matching = matching.join(hits, "id", "left_semi")
    if under_five:
        matching = conversations.under_five_stars(matching, ratings)
    if start or end:
        matching = conversations.in_range(matching, messages, start, end or (1 << 62))
    return conversations.family_page(convs, size, number, matching.select("id"))


def recompute_coverage(rows: DataFrame, commit_tokens: DataFrame, message_tokens: DataFrame, emails: list[str] | None = None, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """New coverage, links and lines of commits, and their totals.

    With `emails`, only commits of these authors are attributed; others keep their
    total and have no lines from agents. files: (commit_id, path, ignored, moved,
    lines_total); lines of ignored files count nowhere, and ignored and moved files
    take no part in the fallback.
    """
    if files is not None:
        commit_tokens = commit_tokens.join(files.filter("ignored").select("commit_id", "path"), ["commit_id", "path"], "left_anti")
    own, tokens = rows, commit_tokens
    if emails is not None:
        own = rows.filter(F.lower("user_email").isin([e.lower() for e in emails])) if emails else rows.limit(0)
        tokens = commit_tokens.join(own.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")
    matched = stored(attribution.match_lines(own, tokens, message_tokens))
    fallback = stored(attribution.fallback_lines(own, tokens, matched, message_tokens, files))
    by_file = attribution.lines_by_agent(tokens, matched, fallback)
    totals = commit_tokens.groupBy("commit_id").agg(F.count_if("attributable").alias("lines_total"))
    lines = by_file.groupBy("commit_id").agg(F.sum("lines").alias("lines_from_agent"))
    totals = totals.join(lines, "commit_id", "left").na.fill(0, ["lines_from_agent"])
    return {"files": by_file, "links": attribution.links(matched, fallback), "lines": matched, "commits": totals}
