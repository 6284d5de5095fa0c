"""Further queries of the engine: ingestion, upkeep, transcripts, diffs and scalar functions, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import table, view
from .functions import diffs, payloads, text
from .operators import attribution, commits, conversations, messages, mutations, projects, search
from .plans import api
from .queries import _WINDOWED, _token_tables, query, shared_folder
from .sinks import export
from .sources import connectors, transcripts
from .streaming import checkpoints

# ---- conversations and messages


def _stored_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Messages of odd ids as stored, of even ids as new; errors carry a diff."""
    rows = view(spark, sf_dir, "messages").withColumns({"model": F.coalesce("model", F.lit("")), "raw_json": F.lit("")})
    edit = F.concat(F.lit("\ndiff --git a/f"), F.col("id") % 4, F.lit(" b/f\n+x"))
    rows = rows.withColumn("content", F.concat(F.lit("c"), F.col("id"), F.when(F.col("message_type") == "diff", edit).otherwise("")))
    return rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0")


@query(
    """, f AS (SELECT conversation_id, 'f' || (id % 4) AS path, min(timestamp * 1000000 + id) AS seen FROM v_messages WHERE message_type = 'diff' GROUP BY 1, 2),
    e AS (SELECT conversation_id, string_agg(path, chr(10) ORDER BY seen) AS files FROM f GROUP BY 1)
    SELECT m.conversation_id AS id, min(timestamp) FILTER (m.id % 2 = 0) AS started_at, coalesce(max(timestamp) FILTER (m.id % 2 = 0 AND message_type IN ('prompt', 'answer')), 0) AS ended_at,
      count(*) FILTER (message_type = 'prompt') AS user_prompt_count, coalesce(any_value(files), '') AS files_edited
    FROM v_messages m LEFT JOIN e USING (conversation_id) GROUP BY 1 HAVING count(*) FILTER (m.id % 2 = 0) > 0""",
    "messages",
)
def ingested_conversations(spark, sf_dir):
    """Messages inserted, then bounds, prompts and edited files of their conversations."""
    stored, new = _stored_and_new(spark, sf_dir)
    after = messages.insert_messages(stored, new)
    rows = new.select(F.col("conversation_id").alias("id")).distinct()
    rows = rows.withColumns({"started_at": F.lit(0).cast("long"), "ended_at": F.lit(0).cast("long"), "user_prompt_count": F.lit(0).cast("long"), "files_edited": F.lit("")})
    return conversations.refreshed(rows, after, new)


@query("SELECT id, coalesce(model, CASE WHEN id % 2 = 0 THEN 'b' ELSE '' END) AS model FROM v_messages", "messages")
def backfilled_models(spark, sf_dir):
    """A message without a model gets that of a new one at its time."""
    rows = view(spark, sf_dir, "messages").withColumn("model", F.coalesce("model", F.lit("")))
    new = rows.filter("id % 2 = 0").withColumn("model", F.lit("b"))
    return conversations.backfill_models(rows, new).select("id", "model")


@query("SELECT id, conversation_id, rating FROM v_ratings ORDER BY created_at DESC, seq DESC LIMIT 50", "ratings")
def top_ratings(spark, sf_dir):
    """O05"""
    return conversations.top_ratings(view(spark, sf_dir, "ratings"), 501).select("id", "conversation_id", "rating")


@query("SELECT id FROM v_conversations ORDER BY id LIMIT 100", "conversations")
def first_conversations(spark, sf_dir):
    """O06"""
    return conversations.first_conversations(view(spark, sf_dir, "conversations"), 0).select("id")


@query("SELECT c.id, p.path FROM v_conversations c JOIN v_projects p ON c.project_id = p.id WHERE c.agent = 'beta' AND c.id % 3 = 0", "conversations", "projects")
def untitled_conversations(spark, sf_dir):
    """J04"""
    rows = view(spark, sf_dir, "conversations").withColumn("title", F.when(F.col("id") % 3 == 0, "").otherwise("t"))
    return conversations.untitled(rows, view(spark, sf_dir, "projects"), "beta")


@query("SELECT c.id, p.path FROM v_conversations c JOIN v_projects p ON c.project_id = p.id WHERE c.agent = 'gamma' AND parent_conversation_id IS NULL", "conversations", "projects")
def parentless_conversations(spark, sf_dir):
    """J04"""
    return conversations.parentless(view(spark, sf_dir, "conversations"), view(spark, sf_dir, "projects"), "gamma")


@query("SELECT id, message_type FROM v_messages WHERE message_type IN ('prompt', 'final_answer', 'answer', 'question', 'diff') AND conversation_id % 3 = 0 AND NOT (message_type = 'prompt' AND id % 5 = 0)", "messages")
def batch_detail(spark, sf_dir):
    """P15"""
    rows = view(spark, sf_dir, "messages").withColumn("content", F.when(F.col("id") % 5 == 0, "/bb 4 fine").otherwise("text"))
    return conversations.batch_detail(rows, view(spark, sf_dir, "conversations").filter("id % 3 = 0").select("id")).select("id", "message_type")


@query("SELECT id FROM v_messages WHERE id % 6 NOT IN (0, 1, 2, 3)", "messages")
def visible_messages(spark, sf_dir):
    """Blank messages, the marks of commands, and commands that a rating was matched with are hidden."""
    shown = F.when(F.col("id") % 6 == 0, "  ").when(F.col("id") % 6 == 1, "[user]").when(F.col("id") % 6 == 2, "/clear").otherwise("text")
    rows = view(spark, sf_dir, "messages").withColumn("content", shown)
    return conversations.visible_messages(rows, rows.filter("id % 6 = 3").select(F.col("id").alias("message_id"))).select("id")


@query(
    """SELECT m.id, m.conversation_id, 't' || c.id AS title, c.agent FROM v_messages m JOIN v_conversations c ON m.conversation_id = c.id
    WHERE m.role = 'agent' AND message_type = 'diff' AND NOT hidden AND timestamp BETWEEN 1704240000000 AND 1704931200000""",
    "messages", "conversations",
)
def agent_diffs(spark, sf_dir):
    """J03 P04"""
    convs = view(spark, sf_dir, "conversations").withColumn("title", F.concat(F.lit("t"), "id"))
    return conversations.agent_diffs(view(spark, sf_dir, "messages"), convs, 1704240000000, 1704931200000).select("id", "conversation_id", "title", "agent")


@query(
    """, s AS (SELECT *, timestamp - CASE WHEN message_type = 'prompt' THEN 1000 ELSE 0 END AS shown, CASE WHEN message_type IN ('prompt', 'answer', 'final_answer') THEN message_type WHEN message_type = 'diff' THEN 'diffs' ELSE 'logs' END AS kind FROM v_messages WHERE id % 9 <> 0),
    f AS (SELECT *, CASE WHEN kind NOT IN ('diffs', 'logs') OR lag(kind) OVER (PARTITION BY conversation_id ORDER BY shown, id) IS DISTINCT FROM kind THEN 1 ELSE 0 END AS fresh FROM s),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY conversation_id ORDER BY shown, id) AS run FROM f)
    SELECT conversation_id, CAST(run AS BIGINT) AS run, min(kind) AS kind, min(shown) AS first_at, max(shown) AS last_at, count(*) AS n FROM r GROUP BY conversation_id, run""",
    "messages",
)
def timeline_entries(spark, sf_dir):
    """Prompts a second back, questions left out, diffs grouped apart."""
    rows = view(spark, sf_dir, "messages").withColumn("message_type", F.when(F.col("id") % 9 == 0, "question").otherwise(F.col("message_type")))
    return conversations.timeline(rows)


@query("SELECT id, role, message_type FROM v_messages WHERE conversation_id = 8", "messages")
def conversation_detail(spark, sf_dir):
    """S31"""
    ratings = view(spark, sf_dir, "ratings").withColumn("temp_conversation_id", F.lit(""))
    return conversations.detail(view(spark, sf_dir, "conversations").withColumn("started_at", F.lit(0)), view(spark, sf_dir, "messages"), ratings, 8)["messages"].select("id", "role", "message_type")


@query(
    """, h AS (SELECT *, id % 6 AS r FROM v_messages WHERE message_type = 'log') SELECT q.id AS request, CASE WHEN q.id % 4 = 0 THEN 't' || q.id ELSE arg_max('s' || h.conversation_id, (h.timestamp, 's' || h.conversation_id)) END AS session_id
    FROM v_ratings q LEFT JOIN h ON q.id % 4 <> 0 AND h.r = q.rating AND h.timestamp <= q.created_at AND h.timestamp >= q.created_at - 3600000 GROUP BY q.id HAVING q.id % 4 = 0 OR count(h.id) > 0""",
    "messages", "ratings",
)
def session_by_rating(spark, sf_dir):
    """By a known thread, else by rating and note within the time before."""
    logs = view(spark, sf_dir, "messages").filter("message_type = 'log'")
    history = logs.select(F.concat(F.lit("s"), "conversation_id").alias("session_id"), "timestamp", (F.col("id") % 6).cast("int").alias("rating"), F.lit(" n ").alias("note"))
    asked = view(spark, sf_dir, "ratings").select(F.col("id").alias("request"), F.col("created_at").alias("at"), "rating", F.lit("n").alias("note"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("t"), "id")).alias("thread_id"))
    return conversations.session_by_rating(history, asked, 3_600_000)


@query("SELECT conversation_id, list(DISTINCT model ORDER BY model) AS models FROM v_messages WHERE model IS NOT NULL AND message_type = 'log' GROUP BY conversation_id", "messages")
def models_in_conversations(spark, sf_dir):
    """Models of a conversation, here as a set by name."""
    found = payloads.models_seen(view(spark, sf_dir, "messages").filter("message_type = 'log'"))
    return found.select("conversation_id", F.array_sort("models").alias("models"))


@query(
    """, s AS (SELECT conversation_id, model, min(timestamp * 1000000 + id) AS seen FROM v_messages WHERE model IS NOT NULL GROUP BY 1, 2) SELECT conversation_id, list(model ORDER BY seen) AS models FROM s GROUP BY 1""",
    "messages",
)
def models_in_order(spark, sf_dir):
    """Models of a conversation in order of first use."""
    return payloads.models_seen(view(spark, sf_dir, "messages"))


@query("SELECT id FROM v_messages WHERE conversation_id IN (SELECT conversation_id FROM v_messages WHERE role = 'user' AND id % 40 = 0) OR conversation_id IN (SELECT conversation_id FROM v_ratings WHERE rating = 5 AND id % 9 = 0)", "messages", "ratings")
def substantive_messages(spark, sf_dir):
    """P24"""
    rows = view(spark, sf_dir, "messages").withColumn("role", F.when((F.col("role") == "user") & (F.col("id") % 40 == 0), "user").otherwise("agent"))
    return payloads.substantive(rows, view(spark, sf_dir, "ratings").filter("rating = 5 AND id % 9 = 0")).select("id")


# ---- keeping tables


@query(
    """, r AS (SELECT c.id, CASE WHEN c.id % 7 = 3 AND p.id IS NOT NULL THEN p.family_root_id END AS moved FROM v_conversations c LEFT JOIN v_conversations p ON p.id = c.id - 2 WHERE c.id % 7 = 3)
    SELECT c.id, CASE WHEN c.id % 7 = 3 AND parent_conversation_id IS NULL THEN c.id - 2 ELSE parent_conversation_id END AS parent_conversation_id, coalesce(r.moved, c.family_root_id) AS family_root_id FROM v_conversations c LEFT JOIN r ON r.id = c.family_root_id""",
    "conversations",
)
def propagated_roots(spark, sf_dir):
    """A parent is set once, and its root given to all that had the child as root."""
    rows = view(spark, sf_dir, "conversations").select("id", "parent_conversation_id", "family_root_id")
    return mutations.propagate_roots(rows, rows.filter("id % 7 = 3").select("id", (F.col("id") - 2).alias("parent_conversation_id")))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 77 ELSE project_id END AS project_id, CASE WHEN id % 5 = 0 THEN NULL ELSE agent END AS agent FROM v_conversations WHERE id % 5 <> 0 OR id % 3 = 0", "conversations")
def ensured_conversations(spark, sf_dir):
    """K08"""
    rows = view(spark, sf_dir, "conversations").select("id", "project_id", "agent")
    seen = rows.filter("id % 3 = 0").select("id", F.lit(77).cast("long").alias("project_id"))
    return mutations.ensure_conversations(rows.filter("id % 5 != 0"), seen)


@query("""SELECT id, 'u' || id AS url, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 3 = 0 THEN 'new' ELSE '' END WHEN id % 5 = 0 THEN 'new' ELSE 'old' END AS title FROM v_conversations WHERE id % 5 <> 0 OR id % 3 = 0""", "conversations")
def upserted_by_url(spark, sf_dir):
    """A known URL keeps its row and gets a title if it had none."""
    rows = view(spark, sf_dir, "conversations").select("id", F.concat(F.lit("u"), "id").alias("url"), F.when(F.col("id") % 4 == 0, "").otherwise("old").alias("title"))
    imported = rows.filter("id % 3 = 0").withColumn("title", F.when((F.col("id") % 5 == 0) & (F.col("id") % 4 == 0) & (F.col("id") % 3 != 0), "").otherwise("new"))
    return mutations.upsert_by_url(rows.filter("id % 5 != 0"), imported)


@query("SELECT id, CASE WHEN message_type = 'log' AND id % 4 = 0 THEN 'final_answer' ELSE message_type END AS message_type FROM v_messages WHERE id % 10 NOT IN (1, 3)", "messages")
def purged_noise(spark, sf_dir):
    """Noise goes, and logs in the phase of the final answer are typed so."""
    noise = F.when(F.col("id") % 10 == 1, "[event_msg:token_count] 5").when(F.col("id") % 10 == 3, "[response_item:reasoning]").otherwise("a [event_msg:token_count]")
    rows = view(spark, sf_dir, "messages").withColumns({"content": noise, "raw_json": F.when(F.col("id") % 4 == 0, '{"payload": {"phase": "final_answer"}}').otherwise("not json")})
    return mutations.purge_noise(rows).select("id", "message_type")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 5 ELSE conversation_id END AS conversation_id FROM v_ratings WHERE id % 4 <> 0", "ratings")
def kept_ratings(spark, sf_dir):
    """Ratings deleted and pointed to another conversation."""
    rows = view(spark, sf_dir, "ratings")
    left = mutations.delete_ratings(rows, rows.filter("id % 4 = 0"))
    return mutations.point_ratings(left, rows.filter("id % 3 = 0").select("id", F.lit(5).cast("long").alias("conversation_id"))).select("id", "conversation_id")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN '{\"a\":' || (id % 50) || '}' WHEN id % 6 = 1 THEN NULL ELSE 'kept' END AS override_agent_percents FROM v_commits", "commits")
def set_overrides(spark, sf_dir):
    """Percents set, cleared by an empty map, and refused if they make more than 100."""
    rows = view(spark, sf_dir, "commits").withColumn("override_agent_percents", F.lit("kept"))
    part = (F.col("id") % 50).cast("int")
    percents = F.when(F.col("id") % 6 == 0, F.create_map(F.lit("a"), part)).when(F.col("id") % 6 == 1, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).otherwise(F.create_map(F.lit("a"), part + 101))
    given = rows.filter("id % 6 < 3").select("id", percents.alias("percents"))
    return commits.set_override(rows, given).select("id", "override_agent_percents")


@query("SELECT id FROM v_messages WHERE NOT (message_type = 'diff' AND id % 2 = 0 AND conversation_id % 3 = 0)", "messages")
def deleted_derived_diffs(spark, sf_dir):
    """K07"""
    rows = view(spark, sf_dir, "messages").withColumn("raw_json", F.when(F.col("id") % 2 == 0, payloads.DERIVED_DIFF).otherwise("{}"))
    return mutations.delete_derived_diffs(rows, "derived_diff", view(spark, sf_dir, "conversations").filter("id % 3 = 0").select(F.col("id").alias("conversation_id"))).select("id")


@query("SELECT id, CASE WHEN message_type = 'diff' AND id % 2 = 0 THEN 'new' ELSE content END AS content FROM v_messages", "messages")
def replaced_derived_diffs(spark, sf_dir):
    """K06"""
    rows = view(spark, sf_dir, "messages")
    return messages.replace_derived_diffs(rows, rows.filter("message_type = 'diff' AND id % 2 = 0").withColumn("content", F.lit("new"))).select("id", "content")


@query("SELECT id, CASE WHEN project_id % 4 = 1 THEN project_id + 100 ELSE project_id END AS project_id FROM v_conversations", "conversations")
def moved_projects(spark, sf_dir):
    """K10"""
    aliases = view(spark, sf_dir, "projects").filter("id % 4 = 1").select(F.col("id").alias("from_id"), (F.col("id") + 100).alias("to_id"))
    return mutations.move_project(view(spark, sf_dir, "conversations"), aliases).select("id", "project_id")


@query("SELECT id AS key, CASE WHEN id % 3 = 0 THEN 'idle' WHEN id % 3 = 1 THEN 'idle' ELSE 'failed' END AS state FROM v_projects", "projects")
def reset_stuck_states(spark, sf_dir):
    """K16"""
    rows = view(spark, sf_dir, "projects").select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "running").when(F.col("id") % 3 == 1, "queued").otherwise("failed").alias("state"))
    return mutations.reset_stuck(rows)


@query("SELECT id, array_to_string(list_filter([label, '/work/' || lower(label), 'old'], lambda x: x <> ''), '|') AS paths FROM v_projects", "projects")
def merged_paths(spark, sf_dir):
    """U02 U06"""
    a, b = F.array("label", F.lit(" ")), F.array("path", F.col("label"), F.lit("old"))
    return view(spark, sf_dir, "projects").select("id", F.array_join(mutations.ordered_union(a, b), "|").alias("paths"))


# ---- commits


@query("SELECT id FROM v_commits WHERE CASE WHEN id % 3 = 0 THEN user_name = 'Customer#000000007' ELSE user_email IN ('u7', 'u22') END", "commits")
def commits_by_identity(spark, sf_dir):
    """By address whatever its case, by name where there is none."""
    rows = view(spark, sf_dir, "commits").withColumn("user_email", F.when(F.col("id") % 3 == 0, " ").otherwise(F.upper("user_email")))
    return commits.by_identity(rows, "Customer#000000007", ["u7", "U22 "]).select("id")


@query("SELECT id, commit_hash FROM v_commits WHERE commit_hash = 'h7' AND branch_name = (SELECT branch_name FROM v_commits WHERE id = 7)", "commits")
def commit_look_up(spark, sf_dir):
    """S30 S21"""
    rows = view(spark, sf_dir, "commits")
    return commits.look_up(rows.join(F.broadcast(rows.filter("id = 7").select("branch_name")), "branch_name"), commit_hash="h7").select("id", "commit_hash")


@query("SELECT id, id % 5 IN (0, 1, 2) AS hit FROM v_commits", "commits")
def touched_patterns(spark, sf_dir):
    """P20: headers of diffs that meet a changed glob."""
    names = ["src/gen/a.pb.go", "x.lock", "a/b/vendor/c.c", "src/main.go", "lock"]
    heads = [f"diff --git a/{names[0]} b/{names[0]}\n", f"rename from {names[1]}\nrename to y\n", f"--- a/{names[2]}\n+++ b/{names[2]}\n", f"diff --git a/{names[3]} b/{names[3]}\r\n+x.lock", f"+++ b/{names[4]}\n"]
    diff = F.get(F.array(*map(F.lit, heads)), (F.col("id") % 5).cast("int"))
    return view(spark, sf_dir, "commits").select("id", commits.touches_patterns(diff, ["*.pb.go", "*.lock", "**/vendor/**"]).alias("hit"))


@query("SELECT id, id % 9 = 0 AS needs_parent, CASE WHEN id % 9 = 0 THEN 0 ELSE 4 END AS lines_total FROM v_commits", "commits")
def boundary_stubs(spark, sf_dir):
    """D24"""
    rows = view(spark, sf_dir, "commits").withColumn("lines_total", F.lit(4))
    return commits.boundary_stubs(rows, rows.filter("id % 9 = 0").select("commit_hash")).select("id", "needs_parent", "lines_total")


@query(
    """, f AS (SELECT commit_id, path, CAST(sum(lines) AS BIGINT) AS added, count(*) AS removed, bool_or(ignored) AS ignored FROM v_files GROUP BY 1, 2), g AS (SELECT commit_id, path, CAST(sum(lines) AS BIGINT) AS agent FROM v_files WHERE agent IS NOT NULL GROUP BY 1, 2)
    SELECT commit_id, path, added, removed, added + removed AS lines_total, removed AS attributable_lines, CAST(CASE WHEN ignored THEN 0 ELSE coalesce(agent, 0) END AS BIGINT) AS lines_from_agent, ignored,
      round(CASE WHEN removed > 0 THEN CASE WHEN ignored THEN 0 ELSE coalesce(agent, 0) END * 100.0 / removed ELSE 0.0 END, 6) AS line_percent FROM f LEFT JOIN g USING (commit_id, path)""",
    "files",
)
def file_summaries(spark, sf_dir):
    """G16"""
    rows = view(spark, sf_dir, "files")
    files = rows.groupBy("commit_id", "path").agg(F.sum("lines").alias("added"), F.count(F.lit(1)).alias("removed"), F.bool_or("ignored").alias("ignored"))
    tokens = rows.select("commit_id", "path", F.lit(True).alias("attributable"))
    return commits.file_summary(files, tokens, rows.filter("agent IS NOT NULL")).withColumn("line_percent", F.round("line_percent", 6))


@query("SELECT commit_id, CAST(sum(lines) AS BIGINT) AS added, CAST(sum(lines) AS BIGINT) AS removed FROM v_files WHERE NOT ignored GROUP BY 1", "files")
def visible_totals(spark, sf_dir):
    """G36"""
    return commits.visible_totals(view(spark, sf_dir, "files").select("commit_id", F.col("lines").alias("added"), F.col("lines").alias("removed"), "ignored"))


@query(
    """, b AS (SELECT project_id, branch_name, max(id) AS head, CASE WHEN project_id % 5 = 4 THEN 0 ELSE count(*) END AS total FROM v_commits GROUP BY 1, 2)
    SELECT project_id, branch_name, CASE WHEN project_id % 5 = 0 THEN false WHEN total = 0 THEN true WHEN project_id % 5 = 1 THEN head % 2 = 1 WHEN project_id % 5 = 2 THEN true ELSE false END AS due FROM b""",
    "commits",
)
def refresh_due(spark, sf_dir):
    """G34"""
    rows = view(spark, sf_dir, "commits")
    heads = rows.groupBy("project_id", "branch_name").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = heads.withColumns({"head_hash": F.concat(F.lit("h"), "head"), "total": F.when(F.col("project_id") % 5 == 4, 0).otherwise(F.col("n"))})
    kind = F.col("project_id") % 5
    state = heads.filter(kind != 1).select("project_id", "branch_name", F.when(kind == 0, "running").otherwise("idle").alias("state"), F.when(kind == 2, "other").otherwise(F.col("head_hash")).alias("last_head"))
    return commits.refresh_due(heads.select("project_id", "branch_name", "head_hash", "total"), state, rows.filter("id % 2 = 0"))


@query("SELECT project_id, min(1000 + id) AS cutoff FROM v_conversations WHERE NOT hidden AND id % 2 = 0 GROUP BY 1", "conversations")
def earliest_starts(spark, sf_dir):
    """G26"""
    return commits.earliest_start(view(spark, sf_dir, "conversations").withColumn("started_at", F.when(F.col("id") % 2 == 0, F.col("id") + 1000).otherwise(0)))


@query(", e AS (SELECT lower('.' || regexp_extract(path, '\\.([^.]*)$', 1)) AS extension, count(DISTINCT path) AS n FROM v_files GROUP BY 1) SELECT extension, n FROM e WHERE n > 1 ORDER BY n DESC, extension LIMIT 10", "files")
def short_list(spark, sf_dir):
    """The ten extensions of most files."""
    found = view(spark, sf_dir, "files").groupBy(text.extension_key(F.col("path")).alias("extension")).agg(F.countDistinct("path").alias("n"))
    return commits.short_list(found, "n", "extension")


@query(", s AS (SELECT commit_id AS id, agent, CAST(sum(lines) AS DOUBLE) AS percent FROM v_files WHERE agent IS NOT NULL GROUP BY 1, 2) SELECT id, agent, percent FROM s UNION ALL SELECT id, 'manual', 100 - sum(percent) FROM s GROUP BY id HAVING sum(percent) < 100", "files")
def bar_segments(spark, sf_dir):
    """G35"""
    sums = view(spark, sf_dir, "files").filter("agent IS NOT NULL").groupBy(F.col("commit_id").alias("id"), "agent").agg(F.sum("lines").cast("double").alias("percent"))
    return commits.manual_bar(sums)


@query("SELECT id FROM v_commits WHERE coverage_version < 1 OR authored_at * 1000 >= 883612800000 - 300000 OR id % 11 = 0", "commits")
def to_recompute(spark, sf_dir):
    """Of an old version, since a cutoff, or named."""
    rows = view(spark, sf_dir, "commits")
    return attribution.to_recompute(rows, 1, 883612800000, rows.filter("id % 11 = 0").select("id")).select("id")


_VISIBILITY = """, d AS (SELECT project_id, conversation_id, min(timestamp) AS low, max(timestamp) AS high FROM v_messages WHERE message_type = 'diff' AND conversation_id % 10 = 3 GROUP BY 1, 2), c AS (SELECT *, authored_at * 1000 + 806000000000 AS ms FROM v_commits)
    SELECT DISTINCT c.id FROM c JOIN d ON c.project_id = d.project_id AND ms >= low - 604800000 AND ms <= high + 300000"""


@query(_VISIBILITY, "messages", "commits")
def recompute_when_shown(spark, sf_dir):
    """All commits in the window of the diffs."""
    rows = view(spark, sf_dir, "commits").withColumn("authored_at", F.col("authored_at") + 806_000_000)
    own = view(spark, sf_dir, "messages").filter("message_type = 'diff' AND conversation_id % 10 = 3")
    return attribution.to_recompute_for_visibility(rows, own, spark.createDataFrame([], "commit_id long, conversation_id long"), False).select("id")


@query(_VISIBILITY + " WHERE c.id % 150 = d.conversation_id", "messages", "commits")
def recompute_when_hidden(spark, sf_dir):
    """Only commits that are linked."""
    rows = view(spark, sf_dir, "commits").withColumn("authored_at", F.col("authored_at") + 806_000_000)
    own = view(spark, sf_dir, "messages").filter("message_type = 'diff' AND conversation_id % 10 = 3")
    linked = rows.select(F.col("id").alias("commit_id"), (F.col("id") % 150).alias("conversation_id"))
    return attribution.to_recompute_for_visibility(rows, own, linked, True).select("id")


@query("SELECT id, commit_hash FROM v_commits WHERE project_id IN (3, 4) ORDER BY authored_at DESC, commit_hash DESC LIMIT 30", "commits")
def commits_across_projects(spark, sf_dir):
    """One order over several projects."""
    return commits.page(commits.filter_commits(view(spark, sf_dir, "commits"), project_ids=[3, 4]), 30).select("id", "commit_hash")


# ---- projects


@query("SELECT id, path FROM (SELECT id, path, ignored FROM v_projects UNION ALL SELECT id, '/old/' || id, ignored FROM v_projects UNION ALL SELECT id, '/tree/' || id, ignored FROM v_projects) WHERE NOT ignored", "projects")
def tracked_paths(spark, sf_dir):
    """P27"""
    rows = view(spark, sf_dir, "projects").withColumns({"old_paths": F.concat(F.lit("/old/"), "id", F.lit("\n \n")), "git_worktree_paths": F.concat(F.lit(" /tree/"), "id")})
    return projects.tracked_paths(rows).select("id", "path")


@query(
    """, h AS (SELECT DISTINCT project_id FROM v_commits WHERE project_id % 2 = 1), p AS (SELECT git_id, max(id) AS pref FROM v_projects GROUP BY 1),
    r AS (SELECT v.git_id, v.id, row_number() OVER (PARTITION BY v.git_id ORDER BY (v.id IN (FROM h)) DESC, (v.id = pref) DESC, v.id) AS k FROM v_projects v JOIN p USING (git_id)) SELECT git_id, id AS project_id FROM r WHERE k = 1""",
    "projects", "commits",
)
def repo_projects(spark, sf_dir):
    """J26"""
    rows = view(spark, sf_dir, "projects")
    preferred = rows.groupBy("git_id").agg(F.max("id").alias("id"))
    return projects.repo_projects(projects.groups(rows), preferred, view(spark, sf_dir, "commits").filter("project_id % 2 = 1"))


@query("SELECT path, CASE WHEN id % 3 = 2 THEN '/repos/r' || (id % 7) ELSE '/repos/r' || (id % 7) || '/sub' END AS root, CASE WHEN id % 3 = 2 THEN 'r' || (id % 7) ELSE 'sub' END AS label FROM (SELECT DISTINCT id, '/repos/r' || (id % 7) || '/' || CASE id % 3 WHEN 0 THEN 'sub/x' || id WHEN 1 THEN 'tree/y' || id ELSE 'z' || id END AS path FROM v_commits)", "commits")
def git_roots(spark, sf_dir):
    """the deepest root above a path; a worktree is its parent's."""
    kind = F.when(F.col("id") % 3 == 0, F.concat(F.lit("sub/x"), "id")).when(F.col("id") % 3 == 1, F.concat(F.lit("tree/y"), "id")).otherwise(F.concat(F.lit("z"), "id"))
    paths = view(spark, sf_dir, "commits").select(F.concat(F.lit("/repos/r"), F.col("id") % 7, F.lit("/"), kind).alias("path"))
    roots = [(f"/repos/r{i}", "") for i in range(7)] + [(f"/repos/r{i}/sub", "") for i in range(7)] + [(f"/repos/r{i}/tree", f"/repos/r{i}/sub") for i in range(7)]
    return projects.git_roots(paths, spark.createDataFrame(roots, "root string, parent string"))


@query("SELECT '-work-' || (id % 3) AS parent, list_sort(list('-work-' || (id % 3) || '--claude-worktrees-' || id)) AS worktrees FROM v_projects WHERE id % 4 <> 0 GROUP BY 1", "projects")
def known_worktrees(spark, sf_dir):
    """S27"""
    name = F.concat(F.lit("-work-"), F.col("id") % 3, F.when(F.col("id") % 4 != 0, F.concat(F.lit("--claude-worktrees-"), F.col("id"))).otherwise(""))
    return projects.worktrees(view(spark, sf_dir, "projects").select(name.alias("folder")), "--claude-worktrees-")


@query("SELECT 'r' || id AS request, CASE id % 3 WHEN 2 THEN 0 ELSE id END AS project_id, CASE id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rule FROM v_projects", "projects")
def resolved_paths(spark, sf_dir):
    """By exact path, by a path above, by remote."""
    rows = view(spark, sf_dir, "projects")
    known = rows.select("id", F.concat("path", F.col("id")).alias("path"), F.lit("").alias("old_paths"), F.lit("").alias("git_worktree_paths"), F.lit("").alias("alt_remotes"), F.concat(F.lit("git@h.org:o/r"), F.col("id"), F.lit(".git")).alias("remote"))
    path = F.when(F.col("id") % 3 == 0, F.concat("path", F.col("id"))).when(F.col("id") % 3 == 1, F.concat("path", F.col("id"), F.lit("/src/deep"))).otherwise("/elsewhere")
    asked = rows.select(F.concat(F.lit("r"), "id").alias("request"), path.alias("path"), F.when(F.col("id") % 3 == 2, "https://h.org/O/R0").otherwise("").alias("remote"))
    return projects.resolve_paths(asked, known)


@query("SELECT 's' || id AS session_id, id AS project_id FROM v_projects", "projects")
def projects_by_hash(spark, sf_dir):
    """S11"""
    rows = view(spark, sf_dir, "projects").withColumns({"old_paths": F.lit(""), "git_worktree_paths": F.lit("")})
    return projects.resolve_hashes(rows.select(F.concat(F.lit("s"), "id").alias("session_id"), F.sha2("path", 256).alias("project_hash")), rows)


@query("SELECT path, CAST(1000 + max(k) AS BIGINT) AS last_seen, CASE WHEN id % 2 = 0 THEN id END AS project_id FROM v_projects, (SELECT unnest(range(5)) AS k) WHERE id > 3 GROUP BY path, id", "projects")
def importable_projects(spark, sf_dir):
    """S22"""
    rows = view(spark, sf_dir, "projects")
    touched = rows.select("path", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), F.when(F.col("id") > 3, 1000).otherwise(0).alias("base")).select("path", (F.col("base") + F.col("k")).cast("long").alias("last_seen"))
    return projects.importable(touched, rows.filter("id % 2 = 0"), 1000)


@query("SELECT id AS conversation_id, CASE WHEN id % 2 = 0 THEN 'a' || id WHEN id % 3 = 0 THEN 'b' ELSE 'c' END AS title FROM v_conversations", "conversations")
def title_cascade(spark, sf_dir):
    """J24"""
    rows = view(spark, sf_dir, "conversations").select(F.col("id").alias("conversation_id"))
    i = F.col("conversation_id")
    sources = [F.when(i % 2 == 0, F.concat(F.lit("a"), i)).otherwise(" "), F.when(i % 3 == 0, "b").otherwise(""), F.lit("c")]
    return projects.title_cascade(*[rows.select("conversation_id", s.alias("title")) for s in sources])


@query("SELECT commit_hash, branch_name FROM v_commits WHERE branch_name = 'F' AND id % 3 <> 0", "commits")
def commit_range(spark, sf_dir):
    """S19"""
    rows = view(spark, sf_dir, "commits").select("commit_hash", "branch_name")
    both = rows.filter("branch_name = 'F' AND CAST(substr(commit_hash, 2) AS BIGINT) % 3 = 0").withColumn("branch_name", F.lit("base"))
    return connectors.commit_range(rows.unionByName(both), "base", "F").select("commit_hash", "branch_name")


@query("SELECT m.id FROM v_messages m JOIN v_conversations c ON m.conversation_id = c.id WHERE contains(lower(m.content), '\"k\": 6') AND NOT hidden", "messages", "conversations")
def message_search(spark, sf_dir):
    """A term in messages of conversations that are shown."""
    rows = view(spark, sf_dir, "messages")
    shown = view(spark, sf_dir, "conversations").filter("NOT hidden").select(F.col("id").alias("conversation_id"))
    return rows.join(shown, "conversation_id", "left_semi").filter(search.contains([F.col("content")], '"K": 6')).select("id")


# ---- checkpoints of scans


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 7776000000 ELSE least(greatest((id % 1000) * 100000000 - 400000 + 300000, 60000), 7776000000) END AS span FROM v_commits", "commits")
def scan_windows(spark, sf_dir):
    """Five minutes more than the time since the last scan, at least one, at most 90 days."""
    latest = F.when(F.col("id") % 4 == 0, 0).otherwise(F.lit(1_000_000_000_000) - (F.col("id") % 1000) * 100_000_000 + 400_000)
    return view(spark, sf_dir, "commits").select("id", checkpoints.scan_window(latest, F.lit(1_000_000_000_000)).cast("long").alias("span"))


def _scan_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "conversations").select("agent", F.concat(F.lit("/s"), F.col("id") % 7, F.lit("/"), "id").alias("source_key"), "id", (F.col("id") * 10).alias("file_size"), F.col("id").alias("file_mtime_ms"), (F.col("id") * 10).alias("file_offset"), (F.col("id") % 50).alias("updated_at_ms"))


@query("SELECT agent, max(id % 50) AS updated_at_ms FROM v_conversations WHERE id % 7 = 3 GROUP BY agent", "conversations")
def latest_checkpoints(spark, sf_dir):
    """G25"""
    return checkpoints.latest(_scan_state(spark, sf_dir), "/s3")


@query("SELECT '/s' || (id % 7) || '/' || id AS source_key, CASE WHEN id % 3 = 0 THEN id * 10 ELSE id * 20 END AS file_offset FROM v_conversations", "conversations")
def advanced_checkpoints(spark, sf_dir):
    """A source of which all entries were too early stays."""
    columns = ["source_key", "file_size", "file_mtime_ms", "file_offset"]
    state = _scan_state(spark, sf_dir)
    read = state.withColumns({"file_offset": F.col("id") * 20, "n_entries": F.lit(5), "n_late": F.when(F.col("id") % 3 == 0, 5).otherwise(4)})
    return checkpoints.advanced(state.select(columns), read, 0).select("source_key", "file_offset")


@query("SELECT '/s' || (id % 7) || '/' || id AS source_key, CAST(CASE WHEN id % 4 = 1 THEN id * 10 ELSE 0 END AS BIGINT) AS start FROM v_conversations WHERE id % 4 <> 0", "conversations")
def sources_to_read(spark, sf_dir):
    """Grown files go on, shrunk, rewritten and new ones start anew."""
    kind = F.col("id") % 4
    state = _scan_state(spark, sf_dir)
    files = state.select("source_key", F.when(kind == 1, F.col("file_size") + 5).when(kind == 2, F.col("file_size")).otherwise(F.col("file_size")).alias("file_size"), F.when(kind == 0, F.col("file_mtime_ms")).otherwise(F.col("file_mtime_ms") + 1).alias("file_mtime_ms"))
    return checkpoints.to_read(state.filter(kind != 3).select("source_key", "file_size", "file_mtime_ms", "file_offset"), files)


# ---- transcripts, from the driver's conversations written as the agents write them


def _turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their session, time and role as agents write them."""
    at = (F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    rows = view(spark, sf_dir, "turns").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumns({"session": F.concat(F.lit("s"), "conv_id"), "seconds": at, "stamp": F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "who": F.when(F.col("role") == "user", "user").otherwise("assistant")})


_TURNS = """, t AS (SELECT conv_id, turn, 's' || conv_id AS session_id, (1700000000 + conv_id * 1000 + turn) * 1000 AS timestamp, CASE WHEN role = 'user' THEN 'user' ELSE 'agent' END AS role, coalesce(text, '') AS content FROM v_turns)"""


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


@query(_TURNS + " SELECT session_id, timestamp, role, CASE WHEN content = '' THEN CASE WHEN role = 'user' THEN '[user]' ELSE '[assistant]' END ELSE content END AS content, CASE WHEN role = 'user' THEN '' ELSE 'm1' END AS model FROM t", "turns")
def session_files(spark, sf_dir):
    """Session files of one JSON object a line, read back from a folder."""
    rows = _turn_lines(spark, sf_dir)
    message = F.struct(F.col("who").alias("role"), F.when(F.col("who") != "user", "m1").alias("model"), F.when(F.col("turn") % 2 == 0, F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))).otherwise(F.col("text")).alias("content"))
    value = _json(type=F.col("who"), sessionId=F.col("session"), cwd=F.lit("/w"), timestamp=F.col("stamp"), message=message)
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    rows.select(value.alias("value")).unionByName(spark.createDataFrame([('{"type":"user","cwd":"/w"}',), ("not json",)], "value string")).write.text(folder)
    return transcripts.session_lines(transcripts.read_lines(spark, folder)).select("session_id", "timestamp", "role", "content", "model")


@query(_TURNS + " SELECT session_id AS source_file, CAST(min(turn) AS VARCHAR) AS leaf, 'Title ' || session_id AS title FROM t GROUP BY session_id", "turns")
def summary_lines(spark, sf_dir):
    """S04"""
    rows = _turn_lines(spark, sf_dir).groupBy("session").agg(F.min("turn").cast("string").alias("leaf"))
    value = _json(type=F.lit("summary"), leafUuid=F.col("leaf"), summary=F.concat(F.lit("Title "), "session"))
    return transcripts.summaries(rows.select(F.col("session").alias("source_file"), value.alias("value")))


@query(_TURNS + " SELECT session_id, timestamp, 'see ' || content || ' end' AS content FROM t", "turns")
def history_file(spark, sf_dir):
    """The shared history, with pasted texts put in."""
    rows = _turn_lines(spark, sf_dir)
    pasted = F.struct(F.struct(F.lit(1).alias("id"), F.col("text").alias("content")).alias("1"))
    value = _json(display=F.lit("see [Pasted text #1 +3 lines] end"), sessionId=F.col("session"), project=F.lit("/w"), timestamp=F.col("seconds") * 1000, pastedContents=pasted)
    return transcripts.history_lines(rows.select(value.alias("value"), F.lit("f").alias("source_file"))).select("session_id", "timestamp", "content")


@query(_TURNS + " SELECT session_id, timestamp, role, CASE WHEN content = '' THEN '[response_item:message]' ELSE content END AS content, 'm' || (conv_id % 3) AS model FROM t", "turns")
def rollout_files(spark, sf_dir):
    """Typed events whose model holds from the first line of the file."""
    rows = _turn_lines(spark, sf_dir)
    head = rows.groupBy("conv_id", "session").agg(F.min("seconds").alias("seconds")).select("session", F.lit(0).alias("line"), _json(type=F.lit("session_meta"), timestamp=F.col("seconds"), payload=F.struct(F.lit("/w").alias("cwd"), F.concat(F.lit("m"), F.col("conv_id") % 3).alias("model"))).alias("value"))
    payload = F.struct(F.lit("message").alias("type"), F.col("who").alias("role"), F.to_json(F.array(F.struct(F.lit("input_text").alias("type"), F.col("text").alias("text")))).alias("content"))
    body = rows.select("session", (F.col("turn") + 1).alias("line"), _json(type=F.lit("response_item"), timestamp=F.col("stamp"), payload=payload).alias("value"))
    lines = head.unionByName(body).select("value", F.concat(F.lit("/x/rollout-1-"), "session", F.lit(".jsonl")).alias("source_file"), "line")
    return transcripts.rollouts(lines).select("session_id", "timestamp", "role", "content", "model")


@query(_TURNS + " SELECT session_id, timestamp, role, content, 'mm' AS model FROM t", "turns")
def whole_file_sessions(spark, sf_dir):
    """S10"""
    rows = _turn_lines(spark, sf_dir)
    each = F.struct("turn", F.struct(F.col("turn").cast("string").alias("id"), F.col("stamp").alias("timestamp"), F.col("who").alias("type"), F.col("text").alias("content")).alias("m"))
    files = rows.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["m"]).alias("messages"))
    value = _json(sessionId=F.col("session"), model=F.lit("mm"), messages=F.col("messages"), directories=F.array(F.lit("/w")))
    return transcripts.session_documents(files.select(value.alias("value"), F.col("session").alias("source_file"))).select("session_id", "timestamp", "role", "content", "model")


@query(_TURNS + " SELECT session_id AS \"composerId\", CAST(turn AS INT) AS at, content AS text, timestamp FROM t", "turns")
def key_value_conversations(spark, sf_dir):
    """Conversations inline and as headers with their bubbles apart."""
    rows = _turn_lines(spark, sf_dir)
    bubble = F.struct(F.concat(F.lit("b"), "turn").alias("bubbleId"), F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), F.col("text"), F.struct((F.col("seconds") * 1000).alias("clientStartTime")).alias("timingInfo"))
    all_ = rows.groupBy("session", "conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", bubble.alias("b")))), lambda x: x["b"]).alias("all"))
    inline = F.when(F.col("conv_id") % 2 == 0, F.col("all"))
    heads = F.when(F.col("conv_id") % 2 == 1, F.transform("all", lambda b: F.struct(b["bubbleId"].alias("bubbleId"), b["type"].alias("type"))))
    data = all_.select(F.concat(F.lit("composerData:"), "session").alias("key"), _json(composerId=F.col("session"), conversation=inline, fullConversationHeadersOnly=heads).alias("value"))
    apart = rows.filter("conv_id % 2 = 1").select(F.concat(F.lit("bubbleId:"), "session", F.lit(":b"), "turn").alias("key"), F.to_json(bubble).alias("value"))
    return transcripts.composers(data.unionByName(apart)).select("composerId", "at", "text", "timestamp")


@query(_TURNS + " SELECT session_id, timestamp, role, content, 'w' AS model FROM t WHERE content <> ''", "turns")
def cloud_event_lists(spark, sf_dir):
    """S15"""
    rows = _turn_lines(spark, sf_dir)
    event = F.struct(F.col("who").alias("type"), F.col("stamp").alias("created_at"), F.struct(F.col("text").alias("content")).alias("message"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("model"))
    first = F.struct(F.lit("system").alias("type"), F.lit(None).cast("string").alias("created_at"), F.struct(F.lit(None).cast("string").alias("content")).alias("message"), F.col("session").alias("session_id"), F.lit("w").alias("model"))
    files = rows.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", event.alias("e")))), lambda x: x["e"]).alias("events"))
    return transcripts.cloud_events(files.select(F.to_json(F.concat(F.array(first), "events")).alias("value"), F.col("session").alias("source_file"))).select("session_id", "timestamp", "role", "content", "model")


@query(_TURNS + " SELECT session_id, timestamp, 'user' AS role, content FROM t WHERE content <> '' UNION ALL SELECT session_id, timestamp + 1, 'agent', 'done ' || turn FROM t", "turns")
def cloud_task_maps(spark, sf_dir):
    """Items of a turn, each 1 ms after the one before."""
    rows = _turn_lines(spark, sf_dir)
    item = lambda t: F.array(F.struct(F.lit("x").alias("type"), t.alias("text")))
    turn = F.struct(F.col("stamp").alias("created_at"), item(F.col("text")).alias("input_items"), item(F.concat(F.lit("done "), "turn")).alias("output_items"))
    files = rows.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), turn))).alias("turns"))
    return transcripts.cloud_tasks(files.select(_json(turns=F.col("turns")).alias("value"), F.concat(F.lit("/d/"), "session", F.lit(".json")).alias("source_file"))).select("session_id", "timestamp", "role", "content")


@query(_TURNS + " SELECT session_id, CASE WHEN turn % 2 = 0 THEN 99 ELSE timestamp END AS timestamp, role FROM t", "turns")
def web_messages(spark, sf_dir):
    """S26"""
    rows = _turn_lines(spark, sf_dir).select(F.col("session").alias("session_id"), F.when(F.col("turn") % 2 == 0, 0).otherwise(F.col("seconds") * 1000).cast("long").alias("timestamp"), F.when(F.col("who") == "user", "user").otherwise("agent").alias("role"))
    return transcripts.web_conversation(rows.unionByName(rows.withColumn("role", F.lit("tool"))), 99)


@query(_TURNS + " SELECT session_id, timestamp, role FROM t", "turns")
def two_sources(spark, sf_dir):
    """What the history repeats of the files counts once."""
    rows = _turn_lines(spark, sf_dir).select(F.col("session").alias("session_id"), (F.col("seconds") * 1000).alias("timestamp"), F.when(F.col("who") == "user", "user").otherwise("agent").alias("role"), F.concat("text", F.lit(" "), "turn").alias("content"), "turn")
    return transcripts.without_duplicates(rows.filter("role = 'user'"), rows.filter("role = 'agent' OR turn % 4 = 0")).select("session_id", "timestamp", "role")


@query(_TURNS + ", k AS (SELECT *, max(CASE WHEN turn % 3 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS known FROM t) SELECT conv_id, turn, (1700000000 + conv_id * 1000 + known) * 1000 + (turn - known) AS timestamp FROM k", "turns")
def filled_times(spark, sf_dir):
    """Missing times go on by 1 ms a line."""
    rows = _turn_lines(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("seconds") * 1000).alias("timestamp"))
    return transcripts.fill_times(rows, "conv_id", "turn")


# ---- diffs


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a diff that adds its lines to a file."""
    name = F.concat(F.lit("src/"), "source", F.lit("/d"), "id", F.lit(".js"))
    head = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- /dev/null\n+++ b/"), name, F.lit("\n@@ -0,0 +1 @@\n+"))
    body = F.replace(F.replace(F.coalesce("content", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\n+"))
    return view(spark, sf_dir, "corpus").select("id", "source", name.alias("path"), F.concat(head, body).alias("diff_content"))


_DIFF = """, t AS (SELECT id, 'src/' || source || '/d' || id || '.js' AS path, string_split(replace(coalesce(content, ''), chr(13), ''), chr(10)) AS ls FROM v_corpus),
    l AS (SELECT id, path, generate_subscripts(ls, 1) + 3 AS position, unnest(ls) AS line FROM t), n AS (SELECT *, regexp_replace(line, '[\\s\\x0B\\x85\\p{Z}]', '', 'g') AS norm FROM l), k AS (SELECT * FROM n WHERE norm <> '' AND line[1:2] <> '++')"""


@query(_DIFF + " SELECT id, CAST(position AS INT) AS position, path, md5(norm) AS norm, regexp_matches(norm, '[\\p{L}\\p{Nd}]') AS attributable, md5(path || chr(31) || '+' || chr(31) || norm) AS key FROM k", "corpus")
def diff_tokens(spark, sf_dir):
    """Changed lines of diffs with their path, normal form and match keys."""
    rows = diffs.tokens(_diff(spark, sf_dir), "id")
    return rows.select("id", "position", "path", F.md5("norm").alias("norm"), "attributable", F.md5(F.get("keys", F.lit(0))).alias("key"))


@query(_DIFF + " SELECT id, count(*) FILTER (regexp_matches(norm, '[\\p{L}\\p{Nd}]')) AS n_tokens, count(DISTINCT norm) AS n_norms FROM k GROUP BY id", "corpus")
def diff_token_totals(spark, sf_dir):
    """Countable tokens of a diff."""
    return diffs.tokens(_diff(spark, sf_dir), "id").groupBy("id").agg(F.count_if("attributable").alias("n_tokens"), F.countDistinct("norm").alias("n_norms"))


@query(_DIFF + " SELECT id, path, count(*) AS added, CAST(0 AS BIGINT) AS removed FROM k GROUP BY id, path", "corpus")
def changed_files(spark, sf_dir):
    """Changed lines per file of a diff."""
    return diffs.file_changes(_diff(spark, sf_dir), "id")


@query("SELECT doc_id AS id, 'old/' || doc_id AS old_path, 'new/' || doc_id AS path FROM documents")
def renamed_files(spark, sf_dir):
    """Files that a diff moves."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("x\nrename from old/"), "doc_id", F.lit("\nrename to new/"), "doc_id", F.lit("\n")).alias("diff_content"))
    return diffs.renamed_files(rows, "id")


@query("SELECT doc_id AS id, 'diff --git a/a' || doc_id || ' b/a' || doc_id || chr(10) || '+x' || chr(10) AS kept FROM documents")
def without_binary_blocks(spark, sf_dir):
    """F37"""
    kept = F.concat(F.lit("diff --git a/a"), "doc_id", F.lit(" b/a"), "doc_id", F.lit("\n+x\n"))
    whole = F.concat(kept, F.lit("diff --git a/b b/b\nBinary files a/b and b/b differ\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), diffs.without_binary(whole).alias("kept"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'diff --git a/f' || doc_id || ' b/f' || doc_id || chr(10) || '--- a/f' || doc_id || chr(10) || '+++ b/f' || doc_id || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b' || chr(10) ELSE '' END AS diff FROM documents")
def reliable_diffs(spark, sf_dir):
    """Diffs in fences; lists of dashes aren't diffs."""
    i = F.col("doc_id")
    whole = F.concat(F.lit("diff --git a/f"), i, F.lit(" b/f"), i, F.lit("\n--- a/f"), i, F.lit("\n+++ b/f"), i, F.lit("\n@@ -1 +1 @@\n-a\n+b\n"))
    said = F.when(i % 3 == 0, F.concat(F.lit("Done:\n```diff\n"), whole, F.lit("```\nand so on"))).when(i % 3 == 1, "- a list\n+ of things").otherwise("plain")
    return table(spark, sf_dir, "documents").select(i.alias("id"), diffs.reliable_diff_column(said).alias("diff"))


@query("SELECT doc_id AS id, 'diff --git a/n' || doc_id || ' b/n' || doc_id || chr(10) || '--- a/n' || doc_id || chr(10) || '+++ b/n' || doc_id || chr(10) || '@@ -3,1 +3,1 @@' || chr(10) || '-x' || chr(10) || '+y' || chr(10) AS diff FROM documents")
def payload_diffs(spark, sf_dir):
    """Structured patches of payloads, below the folder of the session."""
    i = F.col("doc_id").cast("string")
    patch = F.struct(F.lit(3).alias("oldStart"), F.lit(1).alias("oldLines"), F.lit(3).alias("newStart"), F.lit(1).alias("newLines"), F.array(F.lit("-x"), F.lit("+y")).alias("lines"))
    raw = _json(cwd=F.lit("/w"), toolUseResult=F.struct(F.concat(F.lit("/w/n"), i).alias("filePath"), F.array(patch).alias("structuredPatch")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(diffs.json_diffs_column(raw)).alias("diff"))


@query("SELECT doc_id AS id, 'diff --git a/g.txt b/g.txt' || chr(10) || '--- a/g.txt' || chr(10) || '+++ b/g.txt' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-v' || (doc_id - 1) || chr(10) || '+v' || doc_id || chr(10) AS diff FROM documents WHERE doc_id > 0")
def snapshot_diffs(spark, sf_dir):
    """Whole-file writes against what the conversation wrote before."""
    rows = table(spark, sf_dir, "documents").select(F.lit("c").alias("conversation_id"), F.col("doc_id").alias("timestamp"), F.col("doc_id").cast("string").alias("id"), F.lit("g.txt").alias("path"), F.lit("").alias("original"), F.concat(F.lit("v"), "doc_id").alias("content"), F.lit(False).alias("is_create"))
    return payloads.snapshot_diffs(rows).select(F.col("timestamp").alias("id"), "diff")


@query("SELECT doc_id AS conversation_id, CASE WHEN k = 0 THEN 100 ELSE 102 END AS timestamp, CASE WHEN k = 0 THEN 'log' ELSE 'diff' END AS message_type FROM documents, (SELECT unnest([0, 1]) AS k) UNION ALL SELECT doc_id, 101, 'log' FROM documents")
def derived_diffs(spark, sf_dir):
    """A payload's diff as a message at the next free millisecond."""
    i = F.col("doc_id")
    patch = F.struct(F.lit(1).alias("oldStart"), F.lit(1).alias("newStart"), F.array(F.lit("-x"), F.lit("+y")).alias("lines"))
    raw = _json(toolUseResult=F.struct(F.lit("a.py").alias("filePath"), F.array(patch).alias("structuredPatch")))
    base = table(spark, sf_dir, "documents").select(i.alias("conversation_id"), F.lit("agent").alias("role"), F.lit("log").alias("message_type"), F.lit("x").alias("content"))
    rows = base.withColumns({"id": F.concat(F.lit("a"), F.col("conversation_id")), "timestamp": F.lit(100).cast("long"), "raw_json": raw.substr(F.lit(1), F.lit(1 << 20))})
    rows = rows.unionByName(base.withColumns({"id": F.concat(F.lit("b"), F.col("conversation_id")), "timestamp": F.lit(101).cast("long"), "raw_json": F.lit("{}")}))
    return payloads.with_derived_diffs(rows).select("conversation_id", F.col("timestamp").cast("int").alias("timestamp"), "message_type")


# ---- attribution

_BY_LINE = _WINDOWED.replace("b.source = w.source AND ", "")


@query(_BY_LINE + " SELECT CAST(id AS VARCHAR) AS commit_id, CAST(position AS INT) AS position, CAST(message AS VARCHAR) AS message_id FROM e", "corpus")
def exact_pass(spark, sf_dir):
    """The matcher's exact pass over path keys and the window, one commit a unit."""
    return attribution.match_lines(*_token_tables(spark, sf_dir, True)).filter("pass = 'exact'").select("commit_id", "position", "message_id")


@query(
    _WINDOWED + """, o AS (SELECT a.id, a.norm, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = a.id AND e.position = a.position) GROUP BY 1, 2),
    u AS (SELECT o.id, o.norm, count(*) AS n FROM o JOIN b ON b.norm = o.norm AND b.id <= o.id + 300 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = o.id AND e.message = b.id AND e.place = b.position) GROUP BY 1, 2),
    c AS (SELECT o.id, sum(o.n) AS norms, sum(least(o.n, coalesce(u.n, 0))) AS hits FROM o LEFT JOIN u USING (id, norm) GROUP BY 1), z AS (SELECT id, count(*) AS total FROM a GROUP BY 1), m AS (SELECT id, count(*) AS exact FROM e GROUP BY 1)
    SELECT CAST(z.id AS VARCHAR) AS commit_id, CAST(coalesce(exact, 0) + CASE WHEN hits >= CASE WHEN norms BETWEEN 2 AND 9 AND total < 10 THEN norms ELSE 10 END THEN hits ELSE 0 END AS BIGINT) AS lines
    FROM z LEFT JOIN m USING (id) LEFT JOIN c USING (id) WHERE coalesce(exact, 0) + CASE WHEN hits >= CASE WHEN norms BETWEEN 2 AND 9 AND total < 10 THEN norms ELSE 10 END THEN hits ELSE 0 END > 0""",
    "corpus",
)
def attributed_lines(spark, sf_dir):
    """Lines of each commit by all passes."""
    return attribution.attribute(*_token_tables(spark, sf_dir)).groupBy("commit_id").agg(F.sum("lines").alias("lines"))


@query(_BY_LINE + " SELECT CAST(id AS VARCHAR) AS commit_id, CAST(message AS VARCHAR) AS message_id, count(*) AS lines, message * 1000 AS timestamp FROM e GROUP BY id, message", "corpus")
def contributions(spark, sf_dir):
    """Messages by the lines they gave a commit."""
    rows, mine, theirs = _token_tables(spark, sf_dir, True)
    return conversations.contributions(attribution.match_lines(rows, mine, theirs).filter("pass = 'exact'"), theirs)


@query(_BY_LINE + " SELECT DISTINCT CAST(id AS VARCHAR) AS commit_id, 'c' || (message % 50) AS conversation_id FROM e", "corpus")
def attribution_links(spark, sf_dir):
    """Commits and the conversations that gave them lines."""
    matched = attribution.match_lines(*_token_tables(spark, sf_dir, True)).filter("pass = 'exact'")
    none = spark.createDataFrame([], "commit_id string, path string, conversation_id string, agent string, lines long")
    return attribution.links(matched, none)


# ---- scalar functions


@query(
    """SELECT doc_id AS id, source || '.' || doc_id AS base, 'Sum ' || doc_id AS summary, CASE WHEN doc_id % 8 < 6 THEN CAST(doc_id % 8 AS INT) END AS rating, CASE WHEN doc_id % 8 < 6 THEN 'n ' || doc_id END AS note, '-w-' || doc_id || '-x' AS folder, '/w/' || doc_id AS project,
    CASE WHEN doc_id >= 3600 THEN (doc_id // 3600) || 'h ' || (doc_id % 3600 // 60) || 'm' WHEN doc_id >= 60 THEN (doc_id // 60) || 'm ' || (doc_id % 60) || 's' ELSE doc_id || 's' END AS took,
    CASE WHEN doc_id % 101 IN (0, 100) OR doc_id % 101 > 0 THEN (doc_id % 101) || '%' END AS label, sha256(source || chr(31) || doc_id) AS print, '[A, B' || (doc_id % 3) || ']' AS tools, '/a/b' AS common, doc_id % 2 = 0 AS workflow, '/me/x' || doc_id AS home FROM documents""",
)
def scalar_functions(spark, sf_dir):
    """F16 F20 F21 F22 F27 F28 F29 F30 F33 F35 F44"""
    i = F.col("doc_id").cast("string")
    command = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/bb "), F.col("doc_id") % 8, F.lit(" n "), i)).otherwise(F.concat(F.lit("[$bb](x.md) "), F.col("doc_id") % 8, F.lit(" n "), i))
    flow = F.when(F.col("doc_id") % 4 == 0, "/brate 3").when(F.col("doc_id") % 4 == 2, "Base directory for this skill: x\nThe user wants to rate this conversation.").otherwise("base directory")
    given = text.rating_command(command)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), text.base_name(F.concat(F.lit("a/b/"), "source", F.lit("."), i)).alias("base"), text.summary_title(F.concat(F.lit("**Sum "), i, F.lit("**"))).alias("summary"), given["rating"].alias("rating"), given["note"].alias("note"),
        text.encode_project_path(F.concat(F.lit("/w/"), i, F.lit(".x"))).alias("folder"), text.without_worktree(F.concat(F.lit("/w/"), i, F.lit("/.agent/worktrees/t1/src"))).alias("project"), text.duration(F.col("doc_id") * 1000).alias("took"),
        text.percent_label((F.col("doc_id") % 101).cast("double")).alias("label"), text.fingerprint(F.col("source"), i).alias("print"), payloads.tool_summary(F.array(F.lit("A"), F.lit(" "), F.concat(F.lit("B"), F.col("doc_id") % 3), F.lit("A"))).alias("tools"),
        text.common_folder(F.array(F.concat(F.lit("/a/b/x"), i), F.lit("/a/b/y/z"), F.lit("/a/b"))).alias("common"), text.is_rating_workflow(flow).alias("workflow"), text.own_home(F.concat(F.lit("/mnt/h/x"), i), "/mnt/h", "/me").alias("home"),
    )


@query("SELECT doc_id AS id, (1700000000 + doc_id) * 1000 AS seconds, (1700000000 + doc_id) * 1000 + 5 AS millis, CAST(NULL AS BIGINT) AS other, doc_id % 3 = 0 AS inside, doc_id % 2 = 0 AS meta, '[event_msg:exec] v' || doc_id AS label, '/w' AS cwd, 'a' || chr(10) || doc_id AS joined, CASE WHEN doc_id % 2 = 0 THEN '/d' ELSE '/p/' || doc_id END AS folder, 'm' || doc_id AS model FROM documents")
def payload_functions(spark, sf_dir):
    """What payloads and texts say."""
    i = F.col("doc_id").cast("string")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    raw = F.concat(F.lit('{"isMeta":'), F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"), F.lit(',"deep":{"x":[{"model":" m'), i, F.lit(' "}]},"items":[{"text":"a"},{"text":""},{"text":"'), i, F.lit('"}]}'))
    payload = F.concat(F.lit('{"type":"exec","name":"","command":"v'), i, F.lit('","text":"t"}'))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), text.datetime_ms(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("seconds"), text.epoch_ms(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".005Z"))).alias("millis"), text.epoch_ms(F.lit("soon")).alias("other"),
        text.within(F.concat(F.lit("/p"), F.col("doc_id") % 3, F.lit("/x")), ["/p0", "/q"]).alias("inside"), payloads.is_meta(raw).alias("meta"), payloads.event_label(F.lit("event_msg"), payload).alias("label"),
        F.get_json_object(payloads.with_cwd(raw, F.lit("/w")), "$.cwd").alias("cwd"), payloads.json_texts(raw, "$.items").alias("joined"),
        payloads.folder_of_tool(F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("rel"), F.lit("/d"))).otherwise(F.array(F.lit("rel"))), F.concat(F.lit('{"path":"/p/'), i, F.lit('","file_path":"rel"}'))).alias("folder"), payloads.model_column(raw).alias("model"),
    )


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'question' WHEN 1 THEN 'answer' WHEN 2 THEN 'final_answer' ELSE 'prompt' END AS message_type, CASE doc_id % 4 WHEN 0 THEN 'Which ' || doc_id || '?' WHEN 1 THEN 'Question: Which?' || chr(10) || chr(10) || '- [x] **A**' || chr(10) || '- [ ] **B**' ELSE 'said' END AS content FROM documents")
def classified_payloads(spark, sf_dir):
    """Questions, answers and final answers by their payload."""
    i, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    ask = F.concat(F.lit('{"message":{"content":[{"type":"tool_use","name":"AskUserQuestion","input":{"questions":[{"question":"Which '), i, F.lit('?"}]}}]}}'))
    answer = F.lit('{"toolUseResult":{"questions":[{"question":"Which?","options":[{"label":"A"},{"label":"B"}]}],"answers":{"Which?":"A"}}}')
    raw = F.when(kind == 0, ask).when(kind == 1, answer).when(kind == 2, '{"message":{"stop_reason":"end_turn"}}').otherwise("{}")
    role = F.when(kind.isin(0, 2), "agent").otherwise("user")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), role.alias("role"), F.lit("").alias("message_type"), F.lit("said").alias("content"), raw.alias("raw_json"))
    return payloads.classified(rows).select("id", "message_type", "content")


@query("SELECT CAST(doc_id AS VARCHAR) AS conversation_id, printf('%08x-0000-0000-0000-000000000000', doc_id) AS parent_conversation_id FROM documents WHERE doc_id % 2 = 0")
def parents_from_prompts(spark, sf_dir):
    """A session file that the first real user message names."""
    session = F.concat(F.lit("/p/"), F.lower(F.lpad(F.hex("doc_id"), 8, "0")), F.lit("-0000-0000-0000-000000000000.jsonl"))
    base = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("conversation_id"), session.alias("session"), F.lit("user").alias("role"), (F.col("doc_id") % 2 == 0).alias("names"))
    first = base.select("conversation_id", "role", F.lit(1).alias("timestamp"), F.lit("a").alias("id"), F.lit("<system-reminder> /p/00000000-1111-0000-0000-000000000000.jsonl").alias("content"))
    second = base.select("conversation_id", "role", F.lit(2).alias("timestamp"), F.lit("b").alias("id"), F.when(F.col("names"), F.concat(F.lit("continue "), "session")).otherwise("hello").alias("content"))
    return payloads.parents_from_prompts(first.unionByName(second))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE 'h.org/o/r' || page_id END AS key, CASE page_id % 4 WHEN 3 THEN '' ELSE 'gitlab.com/g/s' END AS short FROM pages""",
)
def remote_keys(spark, sf_dir):
    """ssh, scp-like, git and http remotes, sub-groups kept or cut to three segments."""
    i = F.col("page_id").cast("string")
    forms = F.array(F.concat(F.lit("git@h.org:O/R"), i, F.lit(".git")), F.concat(F.lit("ssh://git@h.org:22/o/r"), i, F.lit(".git")), F.concat(F.lit("https://h.org/O/r"), i, F.lit("/")), F.lit("nowhere"))
    nested = F.array(F.lit("git@gitlab.com:g/s/r.git"), F.lit("https://gitlab.com/G/S/r"), F.lit("git://gitlab.com/g/s/r/x"), F.lit(""))
    at = (F.col("page_id") % 4).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", text.repo_key(F.get(forms, at)).alias("key"), text.repo_key(F.get(nested, at), 3).alias("short"))


@query("SELECT page_id, list_filter(list_distinct_in_order, lambda x: NOT list_contains(['https:', '', 'en'], x)) AS added FROM (SELECT page_id, list_reduce(string_split(url, '/'), lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, CAST([] AS VARCHAR[])) AS list_distinct_in_order FROM pages)")
def added_paths(spark, sf_dir):
    """Parts of each page's address that a known list hasn't, in their order."""
    known = F.array(F.lit("https:"), F.lit(""), F.lit("en"))
    return table(spark, sf_dir, "pages").select("page_id", text.added_paths(known, F.split("url", "/")).alias("added"))


@query("SELECT id FROM v_commits WHERE authored_at >= epoch(TIMESTAMP '1997-12-26') AND authored_at < epoch(TIMESTAMP '1998-01-02')", "commits")
def preset_range(spark, sf_dir):
    """the last seven days of a day, that day included."""
    start, end = (int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp()) for day in text.date_range("7d", "1998-01-01"))
    return commits.filter_commits(view(spark, sf_dir, "commits"), start=start, end=end).select("id")


# ---- exports and rescans

_PROMPTS = """, p AS (SELECT conversation_id, string_agg('> ' || content, chr(10) || chr(10) ORDER BY timestamp, content) AS quotes FROM v_messages WHERE message_type = 'prompt' GROUP BY 1)"""


@query(
    _PROMPTS + """, c AS (SELECT id % 150 AS conversation_id, string_agg('- `' || commit_hash[1:8] || '` ' || subject, chr(10) ORDER BY authored_at, commit_hash, subject) AS made FROM v_commits GROUP BY 1)
    SELECT v.id AS conversation_id, '## t' || v.id || chr(10) || chr(10) || coalesce(quotes, '') || CASE WHEN made IS NULL THEN '' ELSE chr(10) || chr(10) || made END AS section FROM v_conversations v LEFT JOIN p ON p.conversation_id = v.id LEFT JOIN c ON c.conversation_id = v.id""",
    "messages", "commits", "conversations",
)
def prompts_export(spark, sf_dir):
    """Conversations with their prompts and the commits they led to."""
    rows = view(spark, sf_dir, "conversations").withColumns({"title": F.concat(F.lit("t"), "id"), "started_at": F.col("id")})
    links = view(spark, sf_dir, "commits").select(F.col("id").alias("commit_id"), (F.col("id") % 150).alias("conversation_id"))
    return export.prompts_markdown(rows, view(spark, sf_dir, "messages").filter("message_type = 'prompt'"), links, view(spark, sf_dir, "commits")).select("conversation_id", "section")


@query(
    _PROMPTS + """ SELECT v.id AS commit_id, '## ' || subject || ' (`' || commit_hash[1:8] || '`)' || chr(10) || chr(10) || coalesce(quotes, '') AS section FROM v_commits v LEFT JOIN p ON p.conversation_id = v.id % 150""",
    "messages", "commits",
)
def commits_export(spark, sf_dir):
    """Commits with their linked prompts."""
    links = view(spark, sf_dir, "commits").select(F.col("id").alias("commit_id"), (F.col("id") % 150).alias("conversation_id"))
    return export.markdown(view(spark, sf_dir, "commits"), links, view(spark, sf_dir, "messages").filter("message_type = 'prompt'")).select("commit_id", "section")


@query(
    """, p AS (SELECT conversation_id, string_agg('<blockquote>' || replace(content, '"', '&quot;') || '</blockquote>', '' ORDER BY timestamp, content) AS quotes FROM v_messages WHERE message_type = 'prompt' GROUP BY 1)
    SELECT v.id AS commit_id, '<section><h2>' || subject || '</h2>' || coalesce(quotes, '') || '</section>' AS section FROM v_commits v LEFT JOIN p ON p.conversation_id = v.id % 150""",
    "messages", "commits",
)
def html_export(spark, sf_dir):
    """K19"""
    links = view(spark, sf_dir, "commits").select(F.col("id").alias("commit_id"), (F.col("id") % 150).alias("conversation_id"))
    return export.html_sections(view(spark, sf_dir, "commits"), links, view(spark, sf_dir, "messages").filter("message_type = 'prompt'")).select("commit_id", "section")


@query(
    """, m AS (SELECT conversation_id, count(*) AS n FROM v_messages WHERE message_type <> 'log' GROUP BY 1)
    SELECT c.id AS commit_id, count(*) AS n_conversations, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_messages FROM v_commits c JOIN v_conversations v ON v.id IN (c.id % 150, c.id % 7) LEFT JOIN m ON m.conversation_id = v.id GROUP BY 1""",
    "messages", "commits", "conversations",
)
def nested_export(spark, sf_dir):
    """Commits, their conversations and their messages, nested."""
    rows = view(spark, sf_dir, "conversations").withColumns({"title": F.lit("t"), "started_at": F.col("id")})
    pairs = F.explode(F.array_distinct(F.array(F.col("id") % 150, F.col("id") % 7))).alias("conversation_id")
    links = view(spark, sf_dir, "commits").select(F.col("id").alias("commit_id"), pairs)
    out = export.nested_export(links, rows, view(spark, sf_dir, "messages").filter("message_type != 'log'"))
    n = F.aggregate("conversations", F.lit(0), lambda a, c: a + F.size(c["messages"])).cast("long")
    return out.select("commit_id", F.size("conversations").cast("long").alias("n_conversations"), n.alias("n_messages"))


@query(_TURNS + " SELECT session_id, timestamp, '/me/p' || (conv_id % 3) AS cwd FROM t WHERE turn >= 2 AND conv_id % 3 <> 2", "turns")
def rescanned_history(spark, sf_dir):
    """A rescan since a time, in some folders, of a mounted home."""
    at = F.when(F.col("turn") >= 2, F.col("seconds") * 1000).otherwise(5).cast("long")
    rows = _turn_lines(spark, sf_dir).select(F.col("session").alias("session_id"), at.alias("timestamp"), F.concat(F.lit("/mnt/h/p"), F.col("conv_id") % 3).alias("cwd"))
    return transcripts.rescanned(rows, 1000, ["/me/p0", "/me/p1"], "/mnt/h", "/me")


@query(
    """, w AS (SELECT * FROM v_commits WHERE branch_name = 'O' ORDER BY authored_at DESC, commit_hash DESC LIMIT 10000), h AS (SELECT * FROM w WHERE contains(lower(commit_hash || ' ' || subject), 'urgent'))
    SELECT id, commit_hash, (SELECT count(*) FROM h) AS n_found FROM h WHERE CAST(substr(user_email, 2) AS BIGINT) % 3 = 0 ORDER BY authored_at DESC, commit_hash DESC LIMIT 10 OFFSET 10""",
    "commits",
)
def commits_search_page(spark, sf_dir):
    """A page of found commits by some users, with the number found before users were looked at, among the newest 10,000."""
    rows = view(spark, sf_dir, "commits")
    emails = rows.select("user_email").filter("CAST(substr(user_email, 2) AS LONG) % 3 = 0").distinct()
    out = api.found_commits(rows, "O", "urgent", size=10, number=2, emails=emails)
    return out["page"].select("id", "commit_hash", F.lit(out["count"].first()["n_commits"]).cast("long").alias("n_found"))
