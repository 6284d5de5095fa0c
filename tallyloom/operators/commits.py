"""Commit listings, counts, coverage summaries and their allocation to agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import extension_key, header_path, ignored_path, local_date, percentage


def filter_commits(
    commits: DataFrame, branch: str | None = None, project_ids: list | None = None, emails: list[str] | None = None, start: int = 0, end: int = 0, ignored: bool | None = None
) -> DataFrame:
    """Optional predicates over [start, end) in seconds; 0 leaves a side open. All reach the scan."""
    out = commits
    if branch is not None:
        out = out.filter(F.col("branch_name") == branch)
    if project_ids is not None:
        out = out.filter(F.col("project_id").isin(project_ids))
    if emails is not None:
        out = out.filter(F.lower(F.trim("user_email")).isin([e.strip().lower() for e in emails]))
    if start:
        out = out.filter(F.col("authored_at") >= start)
    if end:
        out = out.filter(F.col("authored_at") < end)
    if ignored is not None:
        out = out.filter(F.col("ignored") == ignored)
    return out


def expand_user_filter(selected: list[str], own: list[str], marker: str = "@me+agents") -> list[str]:
    """The marker stands for the user's own addresses; duplicates by case go, order stays."""
    flat = [e for s in selected for e in (own if s == marker else [s])]
    return list({e.strip().lower(): e.strip() for e in reversed(flat)}.values())[::-1]


def newest(commits: DataFrame, n: int) -> DataFrame:
    """The n newest commits, ties by hash; a top-k, whatever n."""
    return commits.orderBy(F.desc("authored_at"), F.desc("commit_hash")).limit(n)


def page(commits: DataFrame, size: int = 20, number: int = 1, newest_first: bool = True) -> DataFrame:
    """One page of at most 1000 commits by time, then hash; a top-k, not a full sort, as the sizes are bounded."""
    time, tie = (F.desc("authored_at"), F.desc("commit_hash")) if newest_first else (F.asc("authored_at"), F.asc("commit_hash"))
    size = min(max(1, size), 1000)
    return commits.orderBy(time, tie).offset(size * (max(1, number) - 1)).limit(size)


def page_count(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def count_by(commits: DataFrame, *keys: str) -> DataFrame:
    return commits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_commits"))


def distinct_users(commits: DataFrame) -> DataFrame:
    """Users by address; of several names the least."""
    return commits.filter(F.trim("user_email") != "").groupBy("user_email").agg(F.min("user_name").alias("user_name"))


def branch_agents(commits: DataFrame, coverage: DataFrame) -> DataFrame:
    joined = coverage.join(commits.select(F.col("id").alias("commit_id"), "branch_name"), "commit_id")
    return joined.filter("lines_from_agent > 0").select("branch_name", "agent").distinct()


def stale(commits: DataFrame, version: int) -> DataFrame:
    """Commits whose cached coverage must be made again."""
    return commits.filter(
        (F.col("coverage_version") < version) | ((F.col("lines_total") > 0) & (F.trim("diff_content") == "")) | ((F.col("lines_from_agent") > 0) & (F.trim("detail_files") == ""))
    )


def by_agent(commits: DataFrame, coverage: DataFrame, agent: str) -> DataFrame:
    """Commits with lines of an agent; the agent `manual` means with none at all."""
    if agent == "manual":
        return commits.filter("lines_from_agent = 0")
    own = coverage.filter((F.col("agent") == agent) & (F.col("lines_from_agent") > 0)).select(F.col("commit_id").alias("id"))
    return commits.join(own, "id", "left_semi")


def commit_summary(commits: DataFrame, coverage: DataFrame, *keys: str) -> DataFrame:
    """Per key: commits, lines, agent lines and percent of commits that aren't ignored."""
    kept = commits.filter(~F.col("ignored"))
    totals = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_commits"), F.sum("lines_total").alias("lines_total"), F.sum("lines_from_agent").alias("lines_from_agent")
    )
    return totals.withColumn("agent_percent", percentage(F.col("lines_from_agent"), F.col("lines_total")))


def agent_summary(commits: DataFrame, coverage: DataFrame, *keys: str) -> DataFrame:
    """Per key and agent: lines and their percent of all lines of the key."""
    kept = commits.filter(~F.col("ignored")).select(F.col("id").alias("commit_id"), *keys)
    agents = coverage.join(kept, "commit_id").groupBy(*keys, "agent").agg(F.sum("lines_from_agent").alias("agent_lines"))
    out = agents.join(commit_summary(commits, coverage, *keys).select(*keys, "lines_total"), list(keys)) if keys else agents.crossJoin(commit_summary(commits, coverage).select("lines_total"))
    return out.withColumn("agent_percent", percentage(F.col("agent_lines"), F.col("lines_total"))).drop("lines_total")


def calendar(spark, first: str, last: str) -> DataFrame:
    """One row `day` for each day of [first, last)."""
    return spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}' - INTERVAL 1 DAY)) AS day")


def daily_commit_summary(commits: DataFrame, first: str, last: str, zone: str | None = None, offset_minutes: int = 0) -> DataFrame:
    """Each day of [first, last): commits listed, and lines summed over those that aren't ignored; empty days are zero."""
    days = calendar(commits.sparkSession, first, last)
    # a day more on either side in plain seconds, which reach the scan, before the exact days of the zone
    low, high = (F.unix_timestamp(F.lit(day), "yyyy-MM-dd") + shift * 86_400 for day, shift in ((first, -2), (last, 2)))
    near = commits.filter((F.col("authored_at") >= low) & (F.col("authored_at") < high))
    dated = near.withColumn("day", local_date(F.col("authored_at") * 1000, zone, offset_minutes))
    dated = dated.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    kept = ~F.col("ignored")
    sums = dated.groupBy("day").agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_if(kept).alias("n_commits"),
        F.sum(F.when(kept, F.col("lines_total"))).alias("lines_total"),
        F.sum(F.when(kept, F.col("lines_from_agent"))).alias("lines_from_agent"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("listed", "n_commits", "lines_total", "lines_from_agent")}
    return days.join(F.broadcast(sums), "day", "left").select("day", *zero.values()).withColumn("agent_percent", percentage(F.col("lines_from_agent"), F.col("lines_total")))


def collapse_empty_days(daily: DataFrame) -> DataFrame:
    """One row for each run of days without commits. The days of a chart are few; they are ordered in one window."""
    empty = F.col("n_commits") == 0
    return daily.withColumn("again", F.coalesce(empty & (F.lag("n_commits").over(W.orderBy("day")) == 0), F.lit(False))).filter(~F.col("again")).drop("again")


def largest_remainder(shares: DataFrame, keys: list[str], item: str, exact: str, most: str | None = None) -> DataFrame:
    """`units`: whole parts of `exact` that add up to its rounded sum per key (at most `most`).

    Floors first; what is missing goes one by one to the largest remainders, ties by item.
    """
    group = W.partitionBy(*keys)
    total = F.floor(F.sum(exact).over(group) + 0.5)
    target = F.least(total, F.col(most)) if most else total
    order = group.orderBy(F.desc(F.col(exact) - F.floor(exact)), F.asc(item))
    missing = target - F.sum(F.floor(exact)).over(group)
    extra = F.when(F.row_number().over(order) <= missing, 1).otherwise(0)
    return shares.withColumn("units", (F.floor(exact) + extra).cast("long"))


def override_segments(commits: DataFrame) -> DataFrame:
    """(id, agent, lines_from_agent) of commits whose percents were set by hand, in whole lines."""
    parsed = commits.withColumn("percents", F.from_json("override_agent_percents", "map<string,int>")).filter(F.size("percents") > 0)
    each = parsed.select("id", "lines_total", F.explode("percents").alias("agent", "percent"))
    return largest_remainder(each.withColumn("exact", F.col("lines_total") * F.col("percent") / 100.0), ["id"], "agent", "exact", "lines_total").select("id", "agent", F.col("units").alias("lines_from_agent"))


def effective_coverage(commits: DataFrame, coverage: DataFrame) -> DataFrame:
    """(id, agent, lines_from_agent): percents set by hand, else measured segments, else one segment `unknown`."""
    by_hand = F.coalesce(F.size(F.from_json("override_agent_percents", "map<string,int>")) > 0, F.lit(False))
    measured = coverage.filter("lines_from_agent > 0").select(F.col("commit_id").alias("id"), "agent", F.col("lines_from_agent").alias("lines"))
    rest = commits.filter(~by_hand).select("id", "lines_from_agent").join(measured, "id", "left").filter("agent IS NOT NULL OR lines_from_agent > 0")
    rest = rest.select("id", F.coalesce("agent", F.lit("unknown")).alias("agent"), F.coalesce("lines", "lines_from_agent").alias("lines_from_agent"))
    return override_segments(commits.filter(by_hand)).unionByName(rest)


def valid_override(percents: Column) -> Column:
    """Percents set by hand: none negative and at most 100 together."""
    values = F.map_values(percents)
    return (F.size(F.filter(values, lambda v: v < 0)) == 0) & (F.aggregate(values, F.lit(0), lambda a, v: a + v) <= 100)


def file_type_coverage(files: DataFrame) -> DataFrame:
    """Per extension: distinct paths, lines, agent lines and percent by hand; ignored files are left out.

    files: (commit_id, path, lines, agent_lines, ignored), one row per file of a commit.
    """
    kept = files.filter(~F.col("ignored")).withColumn("extension", extension_key(F.col("path")))
    out = kept.groupBy("extension").agg(F.countDistinct("path").alias("n_files"), F.sum("lines").alias("lines"), F.sum("agent_lines").alias("agent_lines"))
    return out.withColumn("manual_percent", percentage(F.greatest(F.col("lines") - F.col("agent_lines"), F.lit(0)), F.col("lines")))


def file_type_agents(segments: DataFrame) -> DataFrame:
    """(extension, agent, lines) in whole lines that add up; segments: (path, agent, lines double, ignored)."""
    kept = segments.filter(~F.col("ignored") & F.col("agent").isNotNull()).withColumn("extension", extension_key(F.col("path")))
    exact = kept.groupBy("extension", "agent").agg(F.sum("lines").alias("exact"))
    return largest_remainder(exact, ["extension"], "agent", "exact").select("extension", "agent", F.col("units").alias("lines"))


def default_slice(commits: DataFrame, recent: int = 200, count: int = 20) -> DataFrame:
    """The newest `count` of the newest `recent`, oldest first."""
    return commits.orderBy(F.desc("authored_at"), F.desc("commit_hash")).limit(min(count, recent)).orderBy("authored_at", "commit_hash")


def slice_before(commits: DataFrame, known: DataFrame, count: int) -> DataFrame:
    """The `count` newest commits older than every known one."""
    oldest = commits.join(known, "commit_hash", "left_semi").agg(F.min("authored_at").alias("oldest"))
    older = commits.join(F.broadcast(oldest), F.col("oldest").isNull() | (F.col("authored_at") < F.col("oldest")))
    return older.drop("oldest").orderBy(F.desc("authored_at"), F.desc("commit_hash")).limit(count)


def missing_hashes(wanted: DataFrame, commits: DataFrame) -> DataFrame:
    return wanted.select("commit_hash").distinct().join(commits.select("commit_hash"), "commit_hash", "left_anti")


def ingestion_status(commits: DataFrame, log: DataFrame) -> DataFrame:
    """Per branch: commits in the log, how many of them are ingested, and whether all are."""
    have = commits.select("branch_name", "commit_hash").distinct().withColumn("have", F.lit(1))
    out = log.join(have, ["branch_name", "commit_hash"], "left").groupBy("branch_name").agg(F.count(F.lit(1)).alias("total"), F.count("have").alias("ingested"))
    return out.withColumn("reached_root", F.col("total") == F.col("ingested"))


def manual_bar(segments: DataFrame) -> DataFrame:
    """Segments of a bar with the part by hand: 100 less the agents' percents."""
    rest = segments.groupBy("id").agg(F.greatest(F.lit(0.0), 100.0 - F.sum("percent")).alias("percent")).filter("percent > 0")
    return segments.select("id", "agent", "percent").unionByName(rest.select("id", F.lit("manual").alias("agent"), "percent"))


def look_up(rows: DataFrame, **values) -> DataFrame:
    """At most one row whose columns have these values: a commit by hash and branch or by id, a conversation by URL."""
    for column, value in values.items():
        rows = rows.filter(F.col(column) == value)
    return rows.limit(1)


def set_override(commits: DataFrame, overrides: DataFrame) -> DataFrame:
    """commits with percents by hand from overrides (id, percents map<string,int>); an empty map clears them, an invalid one changes nothing."""
    given = overrides.filter(F.coalesce(valid_override(F.col("percents")), F.lit(False))).select("id", F.when(F.size("percents") > 0, F.to_json("percents")).alias("__percents"), F.lit(True).alias("__given"))
    out = commits.join(given, "id", "left")
    return out.withColumn("override_agent_percents", F.when(F.col("__given"), F.col("__percents")).otherwise(F.col("override_agent_percents"))).select(commits.columns)


def by_identity(commits: DataFrame, name: str, emails: list[str]) -> DataFrame:
    """Commits of an author: by address whatever its case, else, for commits without one, by the exact name."""
    address = F.lower(F.trim("user_email"))
    return commits.filter(F.when(address != "", address.isin([e.strip().lower() for e in emails])).otherwise(F.col("user_name") == name))


def touches_patterns(diff: Column, patterns: list[str]) -> Column:
    """Whether a header of a diff names a file that meets one of the globs; without globs every diff does."""
    if not patterns:
        return F.lit(True)
    rows = F.filter(F.split(F.replace(diff, F.lit("\r\n"), F.lit("\n")), "\n"), lambda r: F.regexp_like(r, F.lit(r"^(?:diff --git |rename from |rename to |--- |\+\+\+ )")))

    def paths(r: Column) -> Column:
        fields = F.split(F.trim(r), r"\s+")
        named = F.array(F.coalesce(F.get(fields, F.lit(2)), F.lit("")), F.coalesce(F.get(fields, F.lit(3)), F.lit("")))
        return F.when(r.startswith("diff --git "), named).otherwise(F.array(F.regexp_replace(r, r"^(?:rename from |rename to |--- |\+\+\+ )", "")))

    return F.exists(F.flatten(F.transform(rows, paths)), lambda p: (header_path(p) != "") & ignored_path(header_path(p), "\n".join(patterns), defaults=False))


def boundary_stubs(commits: DataFrame, boundary: DataFrame) -> DataFrame:
    """commits with those at the boundary of a shallow history (commit_hash) as stubs: they need their parent and have no measure."""
    out = commits.join(boundary.select("commit_hash", F.lit(True).alias("__stub")).distinct(), "commit_hash", "left")
    stub = F.coalesce("__stub", F.lit(False))
    zero = {c: F.when(stub, F.lit(0).cast(commits.schema[c].dataType)).otherwise(F.col(c)) for c in ("lines_total", "lines_from_agent", "lines_added", "lines_removed") if c in commits.columns}
    blank = {c: F.when(stub, "").otherwise(F.col(c)) for c in ("diff_content",) if c in commits.columns}
    return out.withColumns({**zero, **blank, "needs_parent": stub}).select(*commits.columns, *([] if "needs_parent" in commits.columns else ["needs_parent"]))


def file_summary(files: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """Per file of a commit: all its changed lines, those that can be attributed, the agents' and their percent; ignored files have no agent's.

    files: (commit_id, path, added, removed, ignored); tokens: with attributable; lines: (commit_id, path, lines) of agents.
    """
    countable = tokens.groupBy("commit_id", "path").agg(F.count_if("attributable").alias("attributable_lines"))
    agents = lines.groupBy("commit_id", "path").agg(F.sum("lines").alias("agent_lines"))
    out = files.join(countable, ["commit_id", "path"], "left").join(agents, ["commit_id", "path"], "left")
    found = F.when(F.col("ignored"), 0).otherwise(F.coalesce("agent_lines", F.lit(0)))
    out = out.select("commit_id", "path", "added", "removed", (F.col("added") + F.col("removed")).alias("lines_total"), F.coalesce("attributable_lines", F.lit(0)).alias("attributable_lines"), found.cast("long").alias("lines_from_agent"), "ignored")
    return out.withColumn("line_percent", percentage(F.col("lines_from_agent"), F.col("attributable_lines")))


def visible_totals(files: DataFrame) -> DataFrame:
    """(commit_id, added, removed) over files that aren't ignored."""
    return files.filter("NOT ignored").groupBy("commit_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def refresh_due(branches: DataFrame, state: DataFrame, commits: DataFrame) -> DataFrame:
    """(project_id, branch_name, due): whether a branch's commits must be read again.

    branches: (project_id, branch_name, head_hash, total); state: (project_id, branch_name,
    state, last_head). Not while a run is queued or running; else if there are no commits
    yet, if the head isn't the one last processed, or, where none is known, if the head isn't stored.
    """
    keys = ["project_id", "branch_name"]
    stored = commits.select("project_id", F.col("commit_hash").alias("head_hash"), F.lit(True).alias("__stored")).distinct()
    joined = branches.join(state, keys, "left").join(stored, ["project_id", "head_hash"], "left")
    last = F.coalesce("last_head", F.lit(""))
    due = (
        F.when(F.coalesce("state", F.lit("")).isin("queued", "running"), False)
        .when(F.col("total") == 0, True)
        .when(F.coalesce("head_hash", F.lit("")) == "", False)
        .when(last == "", F.col("__stored").isNull())
        .otherwise(last != F.col("head_hash"))
    )
    return joined.select(*keys, due.alias("due"))


def earliest_start(conversations: DataFrame) -> DataFrame:
    """(project_id, cutoff): where a project's visible history begins."""
    return conversations.filter("NOT hidden AND started_at > 0").groupBy("project_id").agg(F.min("started_at").alias("cutoff"))


def short_list(rows: DataFrame, count: str, name: str, most: int = 10) -> DataFrame:
    """The first `most` of the rows that stand for more than one."""
    return rows.filter(F.col(count) > 1).orderBy(F.desc(count), name).limit(most)
