"""Project identity: groups, aliases and the resolution of paths to projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_name, lines, repo_key

#: Roots up to which they are broadcast; beyond it the joins shuffle.
BROADCAST_ROOTS = 500_000


def groups(projects: DataFrame) -> DataFrame:
    """(git_id, ids): projects that share a repository identity."""
    return projects.filter(F.trim(F.col("git_id").cast("string")) != "").groupBy("git_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def known_paths(projects: DataFrame) -> DataFrame:
    """(id, path, kind): current paths, old ones and worktrees."""
    own = projects.select("id", F.lit("path").alias("kind"), "path")
    old = projects.select("id", F.lit("old").alias("kind"), F.explode(lines(F.col("old_paths"))).alias("path"))
    trees = projects.select("id", F.lit("worktree").alias("kind"), F.explode(lines(F.col("git_worktree_paths"))).alias("path"))
    return own.unionByName(old).unionByName(trees)


def ancestors(path: Column) -> Column:
    """A path and the folders above it, deepest first."""
    parts = F.split(path, "/")
    return F.reverse(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def resolve_paths(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """(request, project_id): requests (request, path, remote) by old path prefix, exact path, path above, then remote.

    Each rule is an equi join on a folder of the path or a key of the remote; the best
    rule wins, then the deepest folder, then the least project.
    """
    folders = requests.select("request", F.posexplode(ancestors(F.col("path"))).alias("up", "folder"))
    paths = known_paths(projects).select(F.col("id").alias("project_id"), "kind", F.col("path").alias("folder"))
    met = folders.join(paths, "folder")
    rule = F.when(F.col("kind") == "old", 0).when(F.col("up") == 0, 1).otherwise(2)
    by_path = met.select("request", rule.alias("rule"), "up", "project_id")
    remotes = projects.select(F.col("id").alias("project_id"), F.explode(F.array_append(lines(F.col("alt_remotes")), F.col("remote"))).alias("r"))
    remotes = remotes.select("project_id", repo_key(F.col("r")).alias("key")).filter("key != ''").distinct()
    by_remote = requests.select("request", repo_key(F.col("remote")).alias("key")).join(remotes, "key").select("request", F.lit(3).alias("rule"), F.lit(0).alias("up"), "project_id")
    best = by_path.unionByName(by_remote).groupBy("request").agg(F.min(F.struct("rule", "up", "project_id")).alias("best"))
    return best.select("request", F.col("best.project_id").alias("project_id"), F.col("best.rule").alias("rule"))


def resolve_imports(requests: DataFrame, projects: DataFrame, fallback: str | None = None) -> DataFrame:
    """(request, project_id): imports (request, path, remote) by remote, path, folder above, then the folder's name."""
    by = resolve_paths(requests, projects).select("request", F.when(F.col("rule") == 3, 0).otherwise(F.col("rule") + 1).alias("rule"), "project_id")
    names = projects.select(F.col("id").alias("project_id"), base_name(F.col("path")).alias("name"))
    named = requests.select("request", base_name(F.col("path")).alias("name")).filter("name != ''").join(names, "name").select("request", F.lit(9).alias("rule"), "project_id")
    best = by.unionByName(named).groupBy("request").agg(F.min(F.struct("rule", "project_id")).alias("best"))
    return requests.select("request").join(best, "request", "left").select("request", F.coalesce("best.project_id", F.lit(fallback)).alias("project_id"))


def resolve_hashes(sessions: DataFrame, projects: DataFrame) -> DataFrame:
    """(session_id, project_id) by the SHA-256 of a project's path."""
    hashes = known_paths(projects).select(F.col("id").alias("project_id"), F.sha2("path", 256).alias("project_hash")).groupBy("project_hash").agg(F.min("project_id").alias("project_id"))
    return sessions.join(hashes, "project_hash").select("session_id", "project_id")


def importable(touched: DataFrame, projects: DataFrame, cutoff_ms: int) -> DataFrame:
    """Roots (path, last_seen) touched since a cutoff, with the project they are known as."""
    roots = touched.filter(F.col("last_seen") >= cutoff_ms).groupBy("path").agg(F.max("last_seen").alias("last_seen"))
    return roots.join(projects.select("path", F.col("id").alias("project_id")), "path", "left").orderBy("path")


def branch_list(commits: DataFrame, default: str = "main") -> DataFrame:
    """Branches with commits, the default one first."""
    found = commits.select("branch_name").distinct()
    every = found.union(commits.sparkSession.createDataFrame([(default,)], "branch_name string")).distinct()
    return every.orderBy(F.col("branch_name") != default, "branch_name")


def title_cascade(*sources: DataFrame) -> DataFrame:
    """(conversation_id, title): the title of the first source that has one."""
    ranked = None
    for rank, source in enumerate(sources):
        own = source.filter(F.trim("title") != "").select("conversation_id", F.lit(rank).alias("rank"), "title")
        ranked = own if ranked is None else ranked.unionByName(own)
    return ranked.groupBy("conversation_id").agg(F.min(F.struct("rank", "title")).alias("best")).select("conversation_id", F.col("best.title").alias("title"))


def tracked_paths(projects: DataFrame) -> DataFrame:
    """(id, path, kind) of the paths of projects that aren't ignored."""
    return known_paths(projects.filter(~F.col("ignored")))


def repo_projects(groups_: DataFrame, preferred: DataFrame, commits: DataFrame) -> DataFrame:
    """(git_id, project_id): of each group (git_id, ids) the project that stands for its repository: the preferred one (git_id, id) if it has
    commits, else the first that has, else the preferred, else the first."""
    each = groups_.select("git_id", F.posexplode("ids").alias("at", "project_id")).join(preferred.select("git_id", F.col("id").alias("preferred")), "git_id", "left")
    has = commits.select("project_id", F.lit(True).alias("has")).distinct()
    ranked = each.join(has, "project_id", "left").withColumns({"with": F.coalesce("has", F.lit(False)), "own": F.coalesce(F.col("project_id") == F.col("preferred"), F.lit(False))})
    best = ranked.groupBy("git_id").agg(F.min(F.struct(~F.col("with"), ~F.col("own"), "at", "project_id")).alias("best"))
    return best.select("git_id", F.col("best.project_id").alias("project_id"))


def git_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, label): the deepest known root (root, parent) above each path; a worktree (a root with a parent) is its parent's.

    A path is cut to each depth that roots have, deepest first, so it never leaves its
    row; only the paths themselves are dealt and sorted, to take each once.
    """
    parts, depth = F.split("path", "/"), F.size(F.split("root", "/"))
    known = roots.groupBy("root").agg(F.max(F.coalesce(F.nullif("parent", F.lit("")), "root")).alias("__own"))
    few = known.limit(BROADCAST_ROOTS + 1).count() <= BROADCAST_ROOTS
    one = W.partitionBy("path").orderBy("path")
    rows = paths.select("path").repartition("path").withColumn("__n", F.row_number().over(one)).filter("__n = 1").select("path", F.lit(None).cast("string").alias("root"))
    for n in sorted((r[0] for r in known.select(depth).distinct().collect()), reverse=True):  # as many as a path is deep
        own = known.filter(depth == n).withColumnRenamed("root", "__at")
        rows = rows.withColumn("__at", F.when(F.size(parts) >= n, F.array_join(F.slice(parts, 1, n), "/"))).join(F.broadcast(own) if few else own, "__at", "left")
        rows = rows.select("path", F.coalesce("root", "__own").alias("root"))
    return rows.filter("root IS NOT NULL").withColumn("label", base_name(F.col("root")))


def worktrees(folders: DataFrame, marker: str) -> DataFrame:
    """(parent, worktrees): encoded folder names that hold the marker, by what stands before it."""
    at = F.instr("folder", marker)
    found = folders.filter(at > 0).select(F.substr("folder", F.lit(1), at - 1).alias("parent"), "folder")
    return found.groupBy("parent").agg(F.array_sort(F.collect_set("folder")).alias("worktrees"))
