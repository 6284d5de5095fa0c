"""Upserts, replacements and deletions, as functions from old and new tables to the next table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .messages import is_noise


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new put in by key; the `keep` columns of a row that exists stay as they are."""
    stale = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep], F.lit(True).alias("__exists"))
    fresh = new.join(stale, keys, "left")
    columns = [F.when(F.col("__exists"), F.col(f"__old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in old.columns]
    return old.join(new.select(*keys), keys, "left_anti").select(old.columns).unionByName(fresh.select(*columns))


def upsert_commits(old: DataFrame, new: DataFrame) -> DataFrame:
    """New coverage for known commits; their id, time and marks stay."""
    return upsert(old, new, ["project_id", "commit_hash"], keep=tuple(c for c in ("id", "authored_at", "ignored", "override_agent_percents") if c in old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(old.columns))


def replace_for(old: DataFrame, new: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """old without the rows of ids (key), with the distinct rows of new."""
    return old.join(ids.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns)).distinct()


def set_parent(conversations: DataFrame, parents: DataFrame) -> DataFrame:
    """Parents (id, parent_conversation_id) of conversations that have none yet."""
    fresh = parents.select("id", F.col("parent_conversation_id").alias("__p"))
    known = F.col("parent_conversation_id").cast("string")
    out = conversations.join(fresh, "id", "left")
    return out.withColumn("parent_conversation_id", F.when(known.isNull() | (known == ""), F.coalesce("__p", "parent_conversation_id")).otherwise(F.col("parent_conversation_id"))).select(conversations.columns)


def move_project(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with project_id replaced by aliases (from_id, to_id)."""
    out = rows.join(aliases.select(F.col("from_id").alias("project_id"), "to_id"), "project_id", "left")
    return out.withColumn("project_id", F.coalesce("to_id", "project_id")).select(rows.columns)


def delete_projects(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the projects of ids (id) and what hangs on them; links between commits and conversations stay."""
    projects = ids.select(F.col("id").alias("project_id")).distinct()
    gone_conversations = tables["conversations"].join(projects, "project_id", "left_semi").select(F.col("id").alias("conversation_id"))
    gone_commits = tables["commits"].join(projects, "project_id", "left_semi").select(F.col("id").alias("commit_id"))
    out = dict(tables)
    for name, keys, gone in (
        ("ratings", "conversation_id", gone_conversations), ("messages", "project_id", projects), ("coverage", "commit_id", gone_commits),
        ("conversations", "project_id", projects), ("commits", "project_id", projects), ("sync_state", "project_id", projects),
    ):
        if name in tables:
            out[name] = tables[name].join(gone, keys, "left_anti").select(tables[name].columns)
    out["projects"] = tables["projects"].join(ids.select("id"), "id", "left_anti").select(tables["projects"].columns)
    return out


def set_where(rows: DataFrame, column: str, value, condition) -> DataFrame:
    return rows.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def reset_versions(commits: DataFrame, since: int) -> DataFrame:
    return set_where(commits, "coverage_version", 0, F.col("authored_at") >= since)


def set_flags(rows: DataFrame, flags: DataFrame, column: str, key: str = "id") -> DataFrame:
    """`column` taken from flags (key, value) where given."""
    out = rows.join(flags.select(key, F.col("value").alias("__v")), key, "left")
    return out.withColumn(column, F.coalesce("__v", column)).select(rows.columns)


def reset_stuck(sync_state: DataFrame) -> DataFrame:
    return set_where(sync_state, "state", "idle", F.col("state").isin("running", "queued"))


def delete_derived_diffs(messages: DataFrame, marker: str, conversations: DataFrame | None = None) -> DataFrame:
    """messages without diffs made by the engine (the marker is in their raw JSON), for some conversations or all."""
    derived = (F.col("message_type") == "diff") & F.coalesce(F.col("raw_json"), F.lit("")).contains(marker)
    if conversations is None:
        return messages.filter(~derived)
    own = messages.filter(derived).join(conversations.select("conversation_id"), "conversation_id", "left_semi").select("id")
    return messages.join(own, "id", "left_anti")


def ordered_union(a, b):
    """Two arrays as one, blanks dropped, each value at its first place."""
    return F.array_distinct(F.filter(F.transform(F.concat(a, b), lambda x: F.trim(x)), lambda x: x != ""))


def propagate_roots(conversations: DataFrame, parents: DataFrame) -> DataFrame:
    """conversations with new parents (id, parent_conversation_id) set once, and the parent's root given to all that had the child as root."""
    out = set_parent(conversations, parents)
    roots = conversations.select(F.col("id").alias("parent_conversation_id"), F.col("family_root_id").alias("__root"))
    moved = parents.join(roots, "parent_conversation_id").groupBy(F.col("id").alias("family_root_id")).agg(F.min("__root").alias("__root"))
    out = out.join(moved, "family_root_id", "left")
    return out.withColumn("family_root_id", F.coalesce("__root", "family_root_id")).select(conversations.columns)


def ensure_conversations(conversations: DataFrame, seen: DataFrame) -> DataFrame:
    """conversations with those seen (id, project_id, agent) that are new, and known ones pointed to the project they were seen in."""
    fresh = seen.dropDuplicates(["id"])
    moved = conversations.join(fresh.select("id", F.col("project_id").alias("__p")), "id", "left").withColumn("project_id", F.coalesce("__p", "project_id")).select(conversations.columns)
    return moved.unionByName(fresh.join(conversations.select("id"), "id", "left_anti"), allowMissingColumns=True).select(conversations.columns)


def upsert_by_url(conversations: DataFrame, imported: DataFrame) -> DataFrame:
    """conversations with imported ones (url, title, and the columns of new rows): a known URL keeps its row and gets the title if it had none."""
    titles = imported.filter(F.coalesce("title", F.lit("")) != "").groupBy("url").agg(F.min("title").alias("__title"))
    blank = F.coalesce("title", F.lit("")) == ""
    old = conversations.join(titles, "url", "left").withColumn("title", F.when(blank & F.col("__title").isNotNull(), F.col("__title")).otherwise(F.col("title"))).select(conversations.columns)
    new = imported.dropDuplicates(["url"]).join(conversations.select("url"), "url", "left_anti")
    return old.unionByName(new, allowMissingColumns=True).select(conversations.columns)


def purge_noise(messages: DataFrame) -> DataFrame:
    """messages without noise, and with logs whose payload is in the phase of the final answer typed so."""
    final = (F.get_json_object("raw_json", "$.payload.phase") == "final_answer") & (F.col("message_type") == "log")
    kept = messages.filter(~is_noise(F.col("content")))
    return kept.withColumn("message_type", F.when(final, "final_answer").otherwise(F.col("message_type")))


def delete_ratings(ratings: DataFrame, ids: DataFrame) -> DataFrame:
    return ratings.join(ids.select("id"), "id", "left_anti")


def point_ratings(ratings: DataFrame, found: DataFrame) -> DataFrame:
    """ratings with the conversation found for them (id, conversation_id)."""
    return ratings.join(found.select("id", F.col("conversation_id").alias("__c")), "id", "left").withColumn("conversation_id", F.coalesce("__c", "conversation_id")).select(ratings.columns)
