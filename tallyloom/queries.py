"""The engine's queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import oracle, table, view
from .functions import diffs, text
from .operators import attribution, commits, conversations, messages, mutations, projects, search
from .session import shared_folder
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIRST, LAST = "2024-01-01", "2024-02-05"


def query(sql: str | None = None, *names: str):
    """Registers a function under its name, with its checking SQL over the views `names`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


def measured_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits with lines in all and by agents, from their files."""
    files = view(spark, sf_dir, "files").filter("NOT ignored").groupBy(F.col("commit_id").alias("id"))
    sums = files.agg(F.sum("lines").alias("lines_total"), F.sum(F.when(F.col("agent").isNotNull(), F.col("lines")).otherwise(0)).alias("lines_from_agent"))
    return view(spark, sf_dir, "commits").join(sums, "id", "left").fillna(0, ["lines_total", "lines_from_agent"])


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "files").filter("NOT ignored AND agent IS NOT NULL").groupBy("commit_id", "agent").agg(F.sum("lines").alias("lines_from_agent"))


_MEASURED = """m AS (SELECT c.*, coalesce(t.lines_total, 0) AS lines_total, coalesce(t.lines_from_agent, 0) AS lines_from_agent FROM v_commits c LEFT JOIN (
  SELECT commit_id, CAST(sum(lines) AS BIGINT) AS lines_total, CAST(sum(CASE WHEN agent IS NOT NULL THEN lines ELSE 0 END) AS BIGINT) AS lines_from_agent FROM v_files WHERE NOT ignored GROUP BY commit_id) t ON c.id = t.commit_id),
  cov AS (SELECT commit_id, agent, CAST(sum(lines) AS BIGINT) AS lines_from_agent FROM v_files WHERE NOT ignored AND agent IS NOT NULL GROUP BY commit_id, agent)"""


@query("SELECT id, commit_hash, authored_at FROM v_commits WHERE branch_name = 'F' ORDER BY authored_at DESC, commit_hash DESC LIMIT 20 OFFSET 20", "commits")
def commits_page_desc(spark, sf_dir):
    """The second page of a branch, newest first."""
    return commits.page(commits.filter_commits(view(spark, sf_dir, "commits"), "F"), 20, 2).select("id", "commit_hash", "authored_at")


@query("SELECT id, commit_hash, user_email, authored_at FROM v_commits WHERE branch_name = 'O' AND user_email IN ('u7', 'u11', 'u13', 'u40') AND authored_at >= 820454400 AND authored_at < 978307200 ORDER BY authored_at, commit_hash LIMIT 1000", "commits")
def commits_page_filtered(spark, sf_dir):
    """Users by address, half-open range, oldest first."""
    emails = commits.expand_user_filter(["@me+agents", "U11"], ["u7", "U13", "u40"])
    kept = commits.filter_commits(view(spark, sf_dir, "commits"), "O", emails=emails, start=820454400, end=978307200)
    return commits.page(kept, 1000, 1, newest_first=False).select("id", "commit_hash", "user_email", "authored_at")


@query("SELECT branch_name, user_email, count(*) AS n_commits FROM v_commits GROUP BY branch_name, user_email", "commits")
def commit_counts_by_branch_user(spark, sf_dir):
    """G01 G02"""
    return commits.count_by(view(spark, sf_dir, "commits"), "branch_name", "user_email")


@query("SELECT user_email, min(user_name) AS user_name FROM v_commits GROUP BY user_email", "commits")
def distinct_users(spark, sf_dir):
    """G05"""
    return commits.distinct_users(view(spark, sf_dir, "commits"))


@query("SELECT DISTINCT branch_name FROM v_commits UNION SELECT 'main'", "commits")
def branch_list(spark, sf_dir):
    """G04 J25"""
    return projects.branch_list(view(spark, sf_dir, "commits"))


@query(f", {_MEASURED} SELECT DISTINCT branch_name, agent FROM cov JOIN m ON cov.commit_id = m.id WHERE cov.lines_from_agent > 0", "commits", "files")
def distinct_agents(spark, sf_dir):
    """G04 J01"""
    return commits.branch_agents(view(spark, sf_dir, "commits"), coverage(spark, sf_dir))


@query(f", {_MEASURED} SELECT id FROM m WHERE coverage_version < 1 OR (lines_total > 0 AND id % 5 = 0)", "commits", "files")
def stale_coverage(spark, sf_dir):
    """An old version, or lines without their diff."""
    rows = measured_commits(spark, sf_dir).withColumn("diff_content", F.when(F.col("id") % 5 == 0, " ").otherwise("x")).withColumn("detail_files", F.lit("[]"))
    return commits.stale(rows, 1).select("id")


@query(f", {_MEASURED} SELECT id, lines_total FROM m WHERE lines_from_agent = 0", "commits", "files")
def manual_commits(spark, sf_dir):
    """P10"""
    return commits.by_agent(measured_commits(spark, sf_dir), coverage(spark, sf_dir), "manual").select("id", "lines_total")


@query(f", {_MEASURED} SELECT id, lines_from_agent FROM m WHERE id IN (SELECT commit_id FROM cov WHERE agent = 'beta' AND lines_from_agent > 0)", "commits", "files")
def commits_by_agent(spark, sf_dir):
    """P10 J09"""
    return commits.by_agent(measured_commits(spark, sf_dir), coverage(spark, sf_dir), "beta").select("id", "lines_from_agent")


@query(
    f""", {_MEASURED} SELECT branch_name, count(*) AS n_commits, CAST(sum(lines_total) AS BIGINT) AS lines_total, CAST(sum(lines_from_agent) AS BIGINT) AS lines_from_agent,
    round(CASE WHEN sum(lines_total) > 0 THEN sum(lines_from_agent) * 100.0 / sum(lines_total) ELSE 0.0 END, 6) AS agent_percent FROM m WHERE NOT ignored GROUP BY branch_name""",
    "commits", "files",
)
def commit_summary(spark, sf_dir):
    """G13 F08"""
    return commits.commit_summary(measured_commits(spark, sf_dir), coverage(spark, sf_dir), "branch_name").withColumn("agent_percent", F.round("agent_percent", 6))


@query(
    f""", {_MEASURED}, t AS (SELECT branch_name, sum(lines_total) AS total FROM m WHERE NOT ignored GROUP BY branch_name)
    SELECT branch_name, agent, CAST(sum(cov.lines_from_agent) AS BIGINT) AS agent_lines, round(sum(cov.lines_from_agent) * 100.0 / any_value(total), 6) AS agent_percent
    FROM cov JOIN m ON cov.commit_id = m.id JOIN t USING (branch_name) WHERE NOT ignored GROUP BY branch_name, agent""",
    "commits", "files",
)
def agent_summary(spark, sf_dir):
    """G13 G15 F41"""
    return commits.agent_summary(measured_commits(spark, sf_dir), coverage(spark, sf_dir), "branch_name").withColumn("agent_percent", F.round("agent_percent", 6))


@query(
    f""", {_MEASURED}, d AS (SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
    s AS (SELECT CAST(to_timestamp(authored_at) AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS listed, count(*) FILTER (NOT ignored) AS n_commits,
      sum(lines_total) FILTER (NOT ignored) AS lines_total, sum(lines_from_agent) FILTER (NOT ignored) AS lines_from_agent FROM m GROUP BY 1)
    SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(listed, 0) AS listed, coalesce(n_commits, 0) AS n_commits, CAST(coalesce(lines_total, 0) AS BIGINT) AS lines_total, CAST(coalesce(lines_from_agent, 0) AS BIGINT) AS lines_from_agent,
      round(CASE WHEN lines_total > 0 THEN lines_from_agent * 100.0 / lines_total ELSE 0.0 END, 6) AS agent_percent FROM d LEFT JOIN s USING (day)""",
    "commits", "files",
)
def daily_commit_summary(spark, sf_dir):
    """G14 F10 G28"""
    out = commits.daily_commit_summary(measured_commits(spark, sf_dir), "1996-01-01", "1998-01-01", "UTC")
    return out.withColumns({"day": F.col("day").cast("string"), "agent_percent": F.round("agent_percent", 6)})


@query(
    f""", {_MEASURED}, e AS (SELECT id, lines_total, 'alpha' AS agent, lines_total * (id % 40) / 100.0 AS exact FROM m WHERE id % 4 = 0 UNION ALL SELECT id, lines_total, 'beta', lines_total * 35 / 100.0 FROM m WHERE id % 4 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact - floor(exact) DESC, agent) AS k, least(floor(sum(exact) OVER (PARTITION BY id) + 0.5), lines_total) - sum(floor(exact)) OVER (PARTITION BY id) AS missing FROM e)
    SELECT id, agent, CAST(floor(exact) + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS lines_from_agent FROM r
    UNION ALL SELECT commit_id, agent, cov.lines_from_agent FROM cov JOIN m ON m.id = cov.commit_id WHERE commit_id % 4 <> 0 AND cov.lines_from_agent > 0""",
    "commits", "files",
)
def effective_coverage_override(spark, sf_dir):
    """Percents set by hand go before measured lines."""
    by_hand = F.concat(F.lit('{"alpha": '), F.col("id") % 40, F.lit(', "beta": 35}'))
    rows = measured_commits(spark, sf_dir).withColumn("override_agent_percents", F.when(F.col("id") % 4 == 0, by_hand))
    return commits.effective_coverage(rows, coverage(spark, sf_dir))


@query(
    """, e AS (SELECT lower('.' || regexp_extract(path, '\\.([^.]*)$', 1)) AS extension, path, lines, CASE WHEN agent IS NULL THEN 0 ELSE lines END AS agent_lines FROM v_files WHERE NOT ignored)
    SELECT extension, count(DISTINCT path) AS n_files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(agent_lines) AS BIGINT) AS agent_lines, round((sum(lines) - sum(agent_lines)) * 100.0 / sum(lines), 6) AS manual_percent FROM e GROUP BY extension""",
    "files",
)
def file_type_coverage(spark, sf_dir):
    """G17 F09"""
    files = view(spark, sf_dir, "files").withColumn("agent_lines", F.when(F.col("agent").isNull(), 0).otherwise(F.col("lines")))
    return commits.file_type_coverage(files).withColumn("manual_percent", F.round("manual_percent", 6))


@query(
    """, e AS (SELECT lower('.' || regexp_extract(path, '\\.([^.]*)$', 1)) AS extension, agent, CAST(sum(lines) AS DOUBLE) * 0.625 AS exact FROM v_files WHERE NOT ignored AND agent IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY extension ORDER BY exact - floor(exact) DESC, agent) AS k, floor(sum(exact) OVER (PARTITION BY extension) + 0.5) - sum(floor(exact)) OVER (PARTITION BY extension) AS missing FROM e)
    SELECT extension, agent, CAST(floor(exact) + CASE WHEN k <= missing THEN 1 ELSE 0 END AS BIGINT) AS lines FROM r""",
    "files",
)
def largest_remainder_lines(spark, sf_dir):
    """G19"""
    return commits.file_type_agents(view(spark, sf_dir, "files").withColumn("lines", F.col("lines") * 0.625))


_ACTIVITY = """, s AS (SELECT m.*, c.parent_conversation_id AS parent, c.{unit} AS unit, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, m.id) AS k FROM v_messages m JOIN v_conversations c ON m.conversation_id = c.id WHERE NOT hidden),
    u AS (SELECT *, CAST({local} AS DATE) AS day FROM s WHERE role = 'user' AND NOT (parent IS NOT NULL AND k = 1)),
    l AS (SELECT day, count(*) AS conversations FROM (SELECT unit, arg_max(day, timestamp) AS day FROM u WHERE message_type IN ('prompt', 'answer') GROUP BY unit) GROUP BY day),
    p AS (SELECT day, count(*) FILTER (message_type = 'prompt') AS prompts, count(*) FILTER (message_type = 'answer') AS answers FROM u GROUP BY day),
    d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(d.day, '%Y-%m-%d') AS day, coalesce(conversations, 0) AS conversations, coalesce(prompts, 0) AS prompts, coalesce(answers, 0) AS answers FROM d LEFT JOIN l USING (day) LEFT JOIN p USING (day)"""
_UTC = "to_timestamp(timestamp // 1000) AT TIME ZONE 'UTC'"


def _activity(spark, sf_dir, **options):
    out = conversations.daily_activity(view(spark, sf_dir, "messages"), view(spark, sf_dir, "conversations"), FIRST, LAST, **options)
    return out.withColumn("day", F.col("day").cast("string"))


@query(_ACTIVITY.format(unit="id", local=_UTC), "messages", "conversations")
def daily_activity_utc(spark, sf_dir):
    """G12 G06 J11 W01 T15"""
    return _activity(spark, sf_dir, zone="UTC")


@query(_ACTIVITY.format(unit="id", local="to_timestamp(timestamp // 1000) AT TIME ZONE 'America/Los_Angeles'"), "messages", "conversations")
def daily_activity_tz(spark, sf_dir):
    """G12 F10"""
    return _activity(spark, sf_dir, zone="America/Los_Angeles")


@query(_ACTIVITY.format(unit="family_root_id", local=f"({_UTC}) + INTERVAL 330 MINUTE"), "messages", "conversations")
def daily_activity_family(spark, sf_dir):
    """Families at a fixed offset, given as minutes west."""
    return _activity(spark, sf_dir, offset_minutes=-330, by_family=True)


_BUCKETS = """, r AS (SELECT conversation_id, avg(rating) AS mean FROM v_ratings GROUP BY 1),
    h AS (SELECT agent, CAST(CASE WHEN mean IS NULL THEN 0 ELSE least(greatest(floor(mean + 0.5), 1), 5) END AS INT) AS bucket, count(*) AS n FROM v_conversations c LEFT JOIN r ON c.id = r.conversation_id WHERE NOT hidden GROUP BY 1, 2)"""


@query(_BUCKETS + " SELECT agent, bucket, n FROM h", "ratings", "conversations")
def ratings_by_agent(spark, sf_dir):
    """J05 G09 G10"""
    return conversations.ratings_by_agent(view(spark, sf_dir, "conversations"), view(spark, sf_dir, "ratings"))


@query(
    _BUCKETS + """ SELECT agent, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (bucket > 0), 0) AS BIGINT) AS rated,
    round(coalesce(sum(bucket * n) FILTER (bucket > 0) / sum(n) FILTER (bucket > 0), 0.0), 6) AS average FROM h GROUP BY agent""",
    "ratings", "conversations",
)
def rating_totals(spark, sf_dir):
    """G11 G29"""
    return conversations.rating_totals(ratings_by_agent(spark, sf_dir)).withColumn("average", F.round("average", 6))


@query("SELECT id, id % 400 AS conversation_id FROM v_ratings WHERE id % 400 NOT IN (SELECT id FROM v_conversations)", "ratings", "conversations")
def orphaned_ratings(spark, sf_dir):
    """J06"""
    ratings = view(spark, sf_dir, "ratings").withColumn("conversation_id", F.col("id") % 400)
    return conversations.orphaned_ratings(ratings, view(spark, sf_dir, "conversations")).select("id", "conversation_id")


@query(
    """, h AS (SELECT conversation_id, CAST(conversation_id % 6 AS INT) AS rating, 'n' || (conversation_id % 7) AS note, timestamp FROM v_messages WHERE message_type = 'log'),
    c AS (SELECT r.id, h.conversation_id, abs(h.timestamp - r.created_at) AS gap, row_number() OVER (PARTITION BY r.id ORDER BY abs(h.timestamp - r.created_at), h.timestamp DESC, h.conversation_id) AS k
      FROM v_ratings r JOIN h ON r.rating = h.rating AND r.note = h.note AND abs(h.timestamp - r.created_at) <= 1800000)
    SELECT id, conversation_id, gap FROM c WHERE k = 1""",
    "ratings", "messages",
)
def reconcile_nearest(spark, sf_dir):
    """Nearest in a band, by bins and an equi join."""
    logs = view(spark, sf_dir, "messages").filter("message_type = 'log'")
    history = logs.select("conversation_id", (F.col("conversation_id") % 6).cast("int").alias("rating"), F.concat(F.lit("n"), F.col("conversation_id") % 7).alias("note"), "timestamp")
    return conversations.reconcile_nearest(view(spark, sf_dir, "ratings"), history, 1_800_000)


@query(
    """RECURSIVE, c AS (SELECT r.id AS rating_id, r.conversation_id, r.created_at, r.seq, m.id AS message_id, abs(r.created_at - m.timestamp) AS gap, m.timestamp FROM v_ratings r JOIN v_messages m USING (conversation_id)
      WHERE m.message_type = 'log' AND abs(r.created_at - m.timestamp) <= 3600000),
    q AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, seq DESC) AS i FROM (SELECT DISTINCT rating_id, conversation_id, created_at, seq FROM c)),
    p AS (SELECT q.conversation_id, q.i, q.rating_id, list(c.message_id ORDER BY gap, c.timestamp DESC, CAST(c.message_id AS VARCHAR) DESC) AS options FROM q JOIN c USING (rating_id) GROUP BY ALL),
    g AS (SELECT conversation_id, i, rating_id, options[1] AS message_id, [options[1]] AS used FROM p WHERE i = 1
      UNION ALL SELECT p.conversation_id, p.i, p.rating_id, list_filter(p.options, lambda x: NOT list_contains(g.used, x))[1], list_append(g.used, list_filter(p.options, lambda x: NOT list_contains(g.used, x))[1]) FROM g JOIN p ON p.conversation_id = g.conversation_id AND p.i = g.i + 1)
    SELECT CAST(rating_id AS VARCHAR) AS rating_id, CAST(message_id AS VARCHAR) AS message_id FROM g WHERE message_id IS NOT NULL""",
    "ratings", "messages",
)
def rating_command_match(spark, sf_dir):
    """Greedy one-to-one, newest rating first."""
    return conversations.match_rating_commands(view(spark, sf_dir, "ratings"), view(spark, sf_dir, "messages").filter("message_type = 'log'"), 3_600_000)


@query("""RECURSIVE, up AS (SELECT id, id AS root FROM v_conversations WHERE parent_conversation_id IS NULL OR parent_conversation_id NOT IN (SELECT id FROM v_conversations)
    UNION ALL SELECT c.id, up.root FROM v_conversations c JOIN up ON c.parent_conversation_id = up.id) SELECT id, root AS family_root_id FROM up""", "conversations")  # fmt: skip
def family_roots(spark, sf_dir):
    """J13"""
    return conversations.family_roots(view(spark, sf_dir, "conversations"))


_BOUNDS = """b AS (SELECT conversation_id, min(timestamp) AS started_at, coalesce(max(timestamp) FILTER (message_type IN ('prompt', 'answer')), 0) AS ended_at, count(*) FILTER (message_type = 'prompt') AS user_prompt_count FROM v_messages GROUP BY 1)"""


@query(
    f""", {_BOUNDS}, c AS (SELECT v.*, b.started_at, b.ended_at FROM v_conversations v JOIN b ON v.id = b.conversation_id WHERE NOT hidden),
    f AS (SELECT project_id, family_root_id, max(ended_at) AS latest FROM c GROUP BY 1, 2 ORDER BY latest DESC, family_root_id DESC LIMIT 10 OFFSET 10)
    SELECT id, family_root_id, started_at, CASE WHEN id = family_root_id THEN latest ELSE ended_at END AS shown_at FROM c JOIN f USING (project_id, family_root_id)""",
    "messages", "conversations",
)
def family_page(spark, sf_dir):
    """The second page of families with all members."""
    convs = view(spark, sf_dir, "conversations").join(conversations.bounds(view(spark, sf_dir, "messages")).withColumnRenamed("conversation_id", "id"), "id")
    return conversations.family_page(convs, 10, 2).select("id", "family_root_id", "started_at", "shown_at")


@query(f", {_BOUNDS} SELECT * FROM b", "messages")
def conversation_bounds(spark, sf_dir):
    """G07 G08"""
    return conversations.bounds(view(spark, sf_dir, "messages"))


@query("SELECT id FROM v_conversations WHERE id IN (SELECT conversation_id FROM v_ratings GROUP BY 1 HAVING max(rating) < 5)", "conversations", "ratings")
def under_five_stars(spark, sf_dir):
    """P21"""
    return conversations.under_five_stars(view(spark, sf_dir, "conversations"), view(spark, sf_dir, "ratings")).select("id")


@query("SELECT id FROM v_conversations WHERE id IN (SELECT conversation_id FROM v_messages WHERE timestamp >= 1704240000000 AND timestamp < 1704326400000)", "conversations", "messages")
def conversations_in_range(spark, sf_dir):
    """P22 P05"""
    return conversations.in_range(view(spark, sf_dir, "conversations"), view(spark, sf_dir, "messages"), 1704240000000, 1704326400000).select("id")


@query("SELECT id FROM v_corpus WHERE contains(lower(content), 'the and')", "corpus")
def search_phrase(spark, sf_dir):
    """Q03: one phrase"""
    return view(spark, sf_dir, "corpus").filter(search.contains([F.col("content")], " The and ")).select("id")


@query("SELECT id FROM v_corpus WHERE contains(lower(content), 'the') AND contains(lower(content), 'license')", "corpus")
def search_phrase_and(spark, sf_dir):
    """Q01 Q02: every token of three or more characters"""
    return view(spark, sf_dir, "corpus").filter(search.contains([F.col("content")], "the a License", "all_tokens")).select("id")


@query("SELECT id FROM v_corpus WHERE contains(lower(content), 'zu d')", "corpus")
def search_short_fallback(spark, sf_dir):
    """Q03: only short tokens"""
    return view(spark, sf_dir, "corpus").filter(search.contains([F.col("content")], "zu d", "all_tokens")).select("id")


@query(
    """, a AS (SELECT project_id, count(DISTINCT id) AS n FROM v_corpus WHERE contains(lower(content), 'license') GROUP BY 1), b AS (SELECT project_id, count(DISTINCT commit_hash) AS n FROM v_commits WHERE contains(lower(subject), 'urgent') GROUP BY 1)
    SELECT p.id, label, coalesce(a.n, 0) AS conversation_matches, coalesce(b.n, 0) AS commit_matches FROM v_projects p LEFT JOIN a ON a.project_id = p.id LEFT JOIN b ON b.project_id = p.id WHERE NOT ignored AND coalesce(a.n, 0) + coalesce(b.n, 0) > 0""",
    "corpus", "commits", "projects",
)
def search_projects(spark, sf_dir):
    """Q04 Q06 J20 O07 G03"""
    hits = view(spark, sf_dir, "corpus").filter(search.contains([F.col("content")], "license")).select("project_id", F.col("id").alias("conversation_id"))
    return search.search_projects(view(spark, sf_dir, "projects"), hits, search.search_commits(view(spark, sf_dir, "commits"), "urgent"))


@query(
    """RECURSIVE, s AS (SELECT id, timestamp, conversation_id || '/' || role || '/' || message_type AS k, row_number() OVER (PARTITION BY conversation_id, role, message_type ORDER BY timestamp, id) AS i FROM v_messages),
    r AS (SELECT id, k, i, timestamp AS last, true AS kept FROM s WHERE i = 1
      UNION ALL SELECT s.id, s.k, s.i, CASE WHEN s.timestamp - r.last >= 21600000 THEN s.timestamp ELSE r.last END, s.timestamp - r.last >= 21600000 FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
    SELECT id FROM r WHERE kept""",
    "messages",
)
def near_duplicate_suppression(spark, sf_dir):
    """The anchor is the last kept message."""
    rows = view(spark, sf_dir, "messages").withColumns({"content": F.lit(""), "model": F.lit("")})
    return messages.suppress_repeats(rows, 6 * 3_600_000).select("id")


@query(
    """, n AS (SELECT * FROM v_messages WHERE id % 2 = 0), o AS (SELECT * FROM v_messages WHERE id % 2 = 1)
    SELECT n.id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.conversation_id = n.conversation_id AND o.role = n.role AND o.message_type = n.message_type AND o.model IS NOT DISTINCT FROM n.model AND abs(o.timestamp - n.timestamp) < 7200000)""",
    "messages",
)
def insert_not_exists_band(spark, sf_dir):
    """J10"""
    rows = view(spark, sf_dir, "messages").withColumn("content", F.lit(""))
    return messages.not_yet_stored(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), 7_200_000).select("id")


@query(
    """SELECT conv_id, turn, CASE WHEN r = 'user' AND trim(text) <> '' AND NOT starts_with(trim(text), '/') AND NOT starts_with(trim(text), '$bb') THEN 'prompt' ELSE 'log' END AS kind,
    trim(text) <> '' AND length(trim(text)) < 256 AND regexp_matches(trim(text), '(?s)^[\\[<].*[\\]>]$') AS hidden FROM (SELECT *, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS r FROM v_turns)""",
    "turns",
)
def message_classify(spark, sf_dir):
    """F22 F24 P16"""
    rows = view(spark, sf_dir, "turns").withColumn("r", F.when(F.col("role") == "user", "user").otherwise("agent"))
    return rows.select("conv_id", "turn", messages.canonical_type(F.col("r"), F.lit(""), F.coalesce("text", F.lit(""))).alias("kind"), messages.hidden_on_ingest(F.coalesce("text", F.lit(""))).alias("hidden"))


@query(
    """, f AS (SELECT *, CASE WHEN role = 'user' OR coalesce(lag(role) OVER w, 'user') = 'user' THEN 1 ELSE 0 END AS fresh FROM v_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f)
    SELECT conv_id, CAST(run AS BIGINT) AS run, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, min(role) AS role FROM r GROUP BY conv_id, run""",
    "turns",
)
def timeline_runs(spark, sf_dir):
    """Runs of turns."""
    return conversations.timeline_runs(view(spark, sf_dir, "turns"))


@query("SELECT id, last_value(model IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model FROM v_messages", "messages")
def locf_model(spark, sf_dir):
    """W03"""
    return messages.carry_forward(view(spark, sf_dir, "messages"), "model", ["conversation_id"], ["timestamp", "id"]).select("id", "model")


@query(
    """, k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS i, CASE WHEN id % 4 = 0 THEN timestamp END AS t FROM v_messages),
    a AS (SELECT *, last_value(t IGNORE NULLS) OVER b AS a, last_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, first_value(t IGNORE NULLS) OVER n AS b, first_value(CASE WHEN t IS NOT NULL THEN i END IGNORE NULLS) OVER n AS bi FROM k
      WINDOW b AS (PARTITION BY conversation_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY conversation_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT *, CASE WHEN t IS NOT NULL THEN t WHEN a IS NULL THEN b - (bi - i) WHEN b IS NULL THEN a + (i - ai) ELSE a + CAST(trunc((b - a) * (i - ai) / (bi - ai)) AS BIGINT) END AS x FROM a)
    SELECT id, max(x - i) OVER (PARTITION BY conversation_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i AS timestamp FROM f""",
    "messages",
)
def interpolate_ts(spark, sf_dir):
    """W04"""
    rows = view(spark, sf_dir, "messages").withColumn("timestamp", F.when(F.col("id") % 4 == 0, F.col("timestamp")))
    return messages.interpolate_times(rows, "conversation_id", "id").select("id", "timestamp")


@query(
    """, k AS (SELECT id, conversation_id, timestamp // 3600000 AS t, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp // 3600000, id) AS i FROM v_messages)
    SELECT id, max(t - i) OVER (PARTITION BY conversation_id ORDER BY i) + i AS timestamp FROM k""",
    "messages",
)
def unique_timestamps(spark, sf_dir):
    """W05"""
    rows = view(spark, sf_dir, "messages").withColumn("timestamp", F.expr("timestamp div 3600000"))
    return messages.unique_times(rows, "conversation_id").select("id", "timestamp")


def _lines(spark, sf_dir, odd: int | None = None) -> DataFrame:
    """Lines of the corpus as tokens: of all, or for matching one side from even, the other from odd ids."""
    rows = view(spark, sf_dir, "corpus").filter(F.lit(True) if odd is None else F.col("id") % 2 == odd).select("id", "source", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("position", "line"))
    return rows.withColumn("norm", F.regexp_replace("line", "[ \t\r\n]", "")).filter(text.attributable(F.col("norm")))


_LINES = """, t AS (SELECT id, source, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) - 1 AS position, unnest(string_split(coalesce(content, ''), chr(10))) AS line FROM v_corpus),
    n AS (SELECT id, source, position, regexp_replace(line, '[ \t\r\n]', '', 'g') AS norm FROM t WHERE regexp_matches(line, '[\\p{L}\\p{Nd}]'))"""


@query(_LINES + " SELECT id, count(*) AS n_tokens, count(DISTINCT norm) AS n_norms FROM n GROUP BY id", "corpus")
def token_counts(spark, sf_dir):
    """G22 D15 P19"""
    return _lines(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("norm").alias("n_norms"))


@query(_LINES + " SELECT source, md5(norm) AS norm, count(*) AS n FROM n GROUP BY source, norm", "corpus")
def norm_index(spark, sf_dir):
    """G27"""
    return _lines(spark, sf_dir).groupBy("source", "norm").agg(F.count(F.lit(1)).alias("n")).withColumn("norm", F.md5("norm"))


_EXACT = _LINES + """, a AS (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY position) AS k FROM n WHERE id % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY id DESC, position) AS k FROM n WHERE id % 2 = 1),
    x AS (SELECT a.id AS commit_id, CAST(a.position AS INT) AS position, b.id AS message_id, b.source AS agent FROM a JOIN b USING (norm, k))"""


def _matched(spark, sf_dir) -> DataFrame:
    mine = _lines(spark, sf_dir, 0).withColumnRenamed("id", "commit_id").withColumn("attributable", F.lit(True))
    theirs = _lines(spark, sf_dir, 1).select(F.col("id").alias("message_id"), F.col("source").alias("conversation_id"), F.col("source").alias("agent"), F.col("id").alias("timestamp"), "position", "norm")
    return attribution.exact_by_rank(mine, theirs)


@query(_EXACT + " SELECT * FROM x", "corpus")
def exact_line_attribution(spark, sf_dir):
    """Greedy matching by ranks."""
    return _matched(spark, sf_dir).select("commit_id", "position", "message_id", "agent")


@query(_EXACT + ", c AS (SELECT commit_id, agent, count(*) AS n FROM x GROUP BY 1, 2) SELECT commit_id, arg_min(agent, (-n, agent)) AS conversation_id, max(n) AS n FROM c GROUP BY commit_id", "corpus")
def dominant_source(spark, sf_dir):
    """G21"""
    return attribution.dominant_conversation(_matched(spark, sf_dir), "commit_id").select("commit_id", "conversation_id", "n")


def _token_tables(spark, sf_dir, by_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, their tokens and message tokens, all of the corpus, in the form the full attribution takes; a file for each source, or 256 by line."""

    def tokens(odd: int) -> DataFrame:
        path = F.concat(F.lit("src/"), F.substring(F.md5("norm"), 1, 2) if by_line else F.col("source"), F.lit("/a/file.js"))
        out = _lines(spark, sf_dir, odd).select(F.col("id").cast("string").alias("owner"), "position", path.alias("path"), F.lit("+").alias("sign"), "norm", F.lit("").alias("style"), F.col("id").alias("n"))
        return out.withColumns({"keys": text.match_keys(F.col("path"), F.col("sign"), F.col("norm")), "attributable": F.lit(True)})

    theirs = tokens(1).withColumnRenamed("owner", "message_id").withColumns({"conversation_id": F.concat(F.lit("c"), F.col("n") % 50), "agent": F.concat(F.lit("a"), F.col("n") % 3), "timestamp": F.col("n") * 1000})
    mine = tokens(0).withColumnRenamed("owner", "commit_id")
    return mine.select(F.col("commit_id").alias("id"), F.col("n").alias("authored_at")).distinct(), mine.drop("n"), theirs.drop("n", "attributable")


_WINDOWED = """, t AS (SELECT id, source, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) - 1 AS position, unnest(string_split(coalesce(content, ''), chr(10))) AS line FROM v_corpus),
    n AS (SELECT id, source, position, regexp_replace(line, '[ \t\r\n]', '', 'g') AS norm FROM t WHERE regexp_matches(line, '[\\p{L}\\p{Nd}]')),
    a AS (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY position) AS k FROM n WHERE id % 2 = 0), b AS (SELECT * FROM n WHERE id % 2 = 1),
    x AS (SELECT w.id, w.norm, b.id AS message, b.position AS place, row_number() OVER (PARTITION BY w.id, w.norm ORDER BY b.id DESC, b.position) AS k
      FROM (SELECT DISTINCT id, source, norm FROM a) w JOIN b ON b.source = w.source AND b.norm = w.norm AND b.id <= w.id + 300),
    e AS (SELECT a.id, a.position, a.norm, x.message, x.place FROM a JOIN x USING (id, norm, k))"""


@query(
    _WINDOWED + """, z AS (SELECT id, source, count(*) AS total FROM a GROUP BY 1, 2), pf AS (SELECT id, arg_min(conv, (-n, conv)) AS pref FROM (SELECT id, 'c' || (message % 50) AS conv, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1),
    o AS (SELECT a.id, a.source, a.norm, count(*) AS n FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = a.id AND e.position = a.position) GROUP BY 1, 2, 3),
    v AS (SELECT o.id, o.norm, o.n, 'c' || (b.id % 50) AS conv, 'a' || (b.id % 3) AS agent, b.source = o.source AS own FROM o JOIN b ON o.norm = b.norm AND b.id <= o.id + 300
      WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.id = o.id AND e.message = b.id AND e.place = b.position)),
    p AS (SELECT id, norm, any_value(n) AS n, conv, count(*) AS whole, count(*) FILTER (own) AS same FROM v GROUP BY id, norm, conv), ag AS (SELECT id, conv, min(agent) AS agent FROM v GROUP BY 1, 2),
    u AS (SELECT id, norm, n, conv, level, unnest(range(1, CAST(c AS BIGINT) + 1)) AS left_ FROM (SELECT id, norm, n, conv, 1 AS level, same AS c FROM p UNION ALL SELECT id, norm, n, conv, 2, same FROM p UNION ALL SELECT id, norm, n, conv, 3, greatest(0, whole - 2 * same) FROM p)),
    k AS (SELECT u.*, row_number() OVER (PARTITION BY u.id, norm ORDER BY CASE WHEN conv = pref THEN 0 ELSE 1 END, level, left_ DESC, conv) AS i FROM u LEFT JOIN pf ON pf.id = u.id), s AS (SELECT id, norm, sum(whole) AS supply FROM p GROUP BY 1, 2),
    h AS (SELECT o.id, sum(o.n) AS norms, sum(least(o.n, coalesce(supply, 0))) AS hits FROM o LEFT JOIN s USING (id, norm) GROUP BY 1),
    f AS (SELECT k.id, ag.agent, count(*) AS lines FROM k JOIN s USING (id, norm) JOIN h ON h.id = k.id JOIN z ON z.id = k.id JOIN ag ON ag.id = k.id AND ag.conv = k.conv
      WHERE i <= least(n, supply) AND hits >= CASE WHEN norms BETWEEN 2 AND 9 AND total < 10 THEN norms ELSE 10 END GROUP BY 1, 2),
    l AS (SELECT id, agent, sum(lines) AS lines FROM (SELECT id, 'a' || (message % 3) AS agent, count(*) AS lines FROM e GROUP BY 1, 2 UNION ALL SELECT * FROM f) GROUP BY 1, 2)
    SELECT CAST(id AS VARCHAR) AS commit_id, 'src/' || source || '/a/file.js' AS path, agent, CAST(lines AS BIGINT) AS lines, lines * 100.0 / total AS percent FROM l JOIN z USING (id)""",
    "corpus",
)
def full_attribution(spark, sf_dir):
    """All passes, files by agent."""
    return attribution.attribute(*_token_tables(spark, sf_dir))


@query(
    _LINES + """, a AS (SELECT id, source, norm, count(*) AS n FROM n WHERE id % 2 = 0 GROUP BY ALL), b AS (SELECT id, source, norm, 'c' || (id % 50) AS conv, 'a' || (id % 3) AS agent FROM n WHERE id % 2 = 1),
    w AS (SELECT a.id, a.source, a.norm, a.n, b.conv, b.agent, b.source = a.source AS own FROM a JOIN b ON a.norm = b.norm AND b.id <= a.id + 300),
    p AS (SELECT id, source, norm, any_value(n) AS n, conv, count(*) AS whole, count(*) FILTER (own) AS same FROM w GROUP BY id, source, norm, conv), ag AS (SELECT id, conv, min(agent) AS agent FROM w GROUP BY 1, 2),
    u AS (SELECT id, source, norm, n, conv, level, unnest(range(1, CAST(c AS BIGINT) + 1)) AS left_ FROM (SELECT id, source, norm, n, conv, 1 AS level, same AS c FROM p UNION ALL SELECT id, source, norm, n, conv, 2, same FROM p UNION ALL SELECT id, source, norm, n, conv, 3, greatest(0, whole - 2 * same) FROM p)),
    k AS (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY level, left_ DESC, conv) AS i FROM u), s AS (SELECT id, norm, sum(whole) AS supply FROM p GROUP BY 1, 2),
    h AS (SELECT a.id, sum(a.n) AS norms, sum(least(a.n, coalesce(supply, 0))) AS hits FROM a LEFT JOIN s USING (id, norm) GROUP BY 1)
    SELECT CAST(k.id AS VARCHAR) AS commit_id, 'src/' || k.source || '/a/file.js' AS path, k.conv AS conversation_id, ag.agent, count(*) AS lines FROM k JOIN s USING (id, norm) JOIN h ON h.id = k.id JOIN ag ON ag.id = k.id AND ag.conv = k.conv
    WHERE i <= least(n, supply) AND hits >= CASE WHEN norms BETWEEN 2 AND 9 THEN norms ELSE 10 END GROUP BY k.id, k.source, k.conv, ag.agent""",
    "corpus",
)
def norm_fallback_attribution(spark, sf_dir):
    """One file a commit; a text goes to conversations by the file's path, then by its suffix, then anywhere, most left first."""
    rows, mine, theirs = _token_tables(spark, sf_dir)
    none = spark.createDataFrame([], "commit_id string, position int, path string, message_id string, conversation_id string, agent string, used array<int>")
    return attribution.fallback_lines(rows, mine, none, theirs)


@query("SELECT id, authored_at, CASE WHEN id % 3 = 0 THEN 'new' ELSE subject END AS subject FROM v_commits", "commits")
def upsert_merge(spark, sf_dir):
    """Known commits get new values but keep their time."""
    old = view(spark, sf_dir, "commits").filter("id % 5 != 0")
    new = view(spark, sf_dir, "commits").filter("id % 3 = 0 OR id % 5 = 0")
    new = new.withColumns({"subject": F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("subject")), "authored_at": F.when(F.col("id") % 5 == 0, F.col("authored_at")).otherwise(F.lit(0).cast("long"))})
    return mutations.upsert_commits(old, new).select("id", "authored_at", "subject")


@query("SELECT DISTINCT commit_id, CASE WHEN commit_id % 10 = 0 THEN 'again' ELSE path END AS path FROM v_files", "files")
def replace_partition(spark, sf_dir):
    """K03 K04"""
    old = view(spark, sf_dir, "files").select("commit_id", "path")
    ids = old.filter("commit_id % 10 = 0").select("commit_id")
    return mutations.replace_for(old, ids.distinct().withColumn("path", F.lit("again")), "commit_id", ids)


@query(
    """, p AS (SELECT id FROM v_projects WHERE id % 4 = 0) SELECT 'conversations' AS name, count(*) AS n FROM v_conversations WHERE project_id NOT IN (FROM p) UNION ALL SELECT 'messages', count(*) FROM v_messages WHERE project_id NOT IN (FROM p)
    UNION ALL SELECT 'commits', count(*) FROM v_commits WHERE project_id NOT IN (FROM p) UNION ALL SELECT 'ratings', count(*) FROM v_ratings WHERE conversation_id NOT IN (SELECT id FROM v_conversations WHERE project_id IN (FROM p)) UNION ALL SELECT 'projects', count(*) FROM v_projects WHERE id % 4 <> 0""",
    "projects", "conversations", "messages", "commits", "ratings",
)
def cascade_delete(spark, sf_dir):
    """K11"""
    tables = {n: view(spark, sf_dir, n) for n in ("projects", "conversations", "messages", "commits", "ratings")}
    left = mutations.delete_projects(tables, tables["projects"].filter("id % 4 = 0").select("id"))
    counts = [f.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, f in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@query("SELECT DISTINCT commit_hash FROM v_commits WHERE id % 7 = 0 AND id % 2 = 1", "commits")
def set_difference_hashes(spark, sf_dir):
    """U03 U07 J23"""
    rows = view(spark, sf_dir, "commits")
    return commits.missing_hashes(rows.filter("id % 7 = 0"), rows.filter("id % 2 = 0"))


@query("SELECT branch_name, count(*) AS total, count(*) FILTER (id % 3 <> 0) AS ingested, count(*) = count(*) FILTER (id % 3 <> 0) AS reached_root FROM v_commits GROUP BY branch_name", "commits")
def ingestion_status(spark, sf_dir):
    """G32"""
    rows = view(spark, sf_dir, "commits")
    return commits.ingestion_status(rows.filter("id % 3 != 0"), rows.select("branch_name", "commit_hash"))


@query("""SELECT page_id, list_sort(list_filter(list_distinct(list_concat(a, b)), lambda x: list_contains(a, x) <> list_contains(b, x))) AS changed
    FROM (SELECT page_id, string_split(split_part(url, '?', 1), '/') AS a, string_split(split_part(url, '#', 1), '/') AS b FROM pages)""")  # fmt: skip
def pattern_symmetric_diff(spark, sf_dir):
    """U04 P28"""
    a, b = F.split(F.substring_index("url", "?", 1), "/"), F.split(F.substring_index("url", "#", 1), "/")
    return table(spark, sf_dir, "pages").select("page_id", text.pattern_difference(a, b).alias("changed"))


@query(
    """, p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), s AS (SELECT page_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, array_to_string(list_distinct_ordered, '|') AS aliases FROM (SELECT page_id, CASE WHEN len(parts) > 3 THEN list_concat([path], list_transform(range(2, len(parts) - 1), lambda i: array_to_string(parts[i:], '/'))) ELSE [path] END AS list_distinct_ordered FROM s)""",
    "projects",
)
def path_aliases(spark, sf_dir):
    """F04"""
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.path_aliases(path), "|").alias("aliases"))


@query("SELECT page_id, lower(regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '')) AS key, 'https://' || lower(regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '')) || '/commit/abc' AS page FROM pages")
def repo_key(spark, sf_dir):
    """F17 F18"""
    return table(spark, sf_dir, "pages").select("page_id", text.repo_key(F.col("url")).alias("key"), text.commit_url(F.col("url"), F.lit("abc")).alias("page"))


@query(
    """, l AS (SELECT id, list_distinct(list_filter(list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS s FROM v_corpus)
    SELECT a.id, round(CASE WHEN len(list_distinct(list_concat(a.s, b.s))) > 0 THEN len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) ELSE 1.0 END, 6) AS similarity FROM l a JOIN l b ON b.id = a.id + 1""",
    "corpus",
)
def jaccard_lines(spark, sf_dir):
    """F34"""
    rows = view(spark, sf_dir, "corpus").select("id", "content")
    after = rows.select((F.col("id") - 1).alias("id"), F.col("content").alias("next"))
    return rows.join(after, "id").select("id", F.round(text.line_jaccard(F.col("content"), F.col("next")), 6).alias("similarity"))


@query("SELECT id, CAST(len(list_filter(string_split(content, chr(10)), lambda r: starts_with(r, '+') AND NOT starts_with(r, '+++'))) AS BIGINT) AS added, CAST(len(list_filter(string_split(content, chr(10)), lambda r: starts_with(r, '-') AND NOT starts_with(r, '---'))) AS BIGINT) AS removed FROM (SELECT id, '+a' || chr(10) || '-' || content AS content FROM v_corpus)", "corpus")
def diff_line_counts(spark, sf_dir):
    """G23 G30"""
    rows = view(spark, sf_dir, "corpus").select("id", F.concat(F.lit("+a\n-"), "content").alias("content"))
    return rows.select("id", diffs.added_removed(F.col("content")).alias("c")).select("id", "c.added", "c.removed")


@query(
    """, l AS (SELECT commit_id, agent FROM v_files WHERE agent IS NOT NULL) SELECT c.id, list_sort(list_distinct(list(agent))) AS agents FROM v_commits c JOIN l ON l.commit_id = c.id GROUP BY c.id""",
    "commits", "files",
)
def commit_links(spark, sf_dir):
    """J02 D27"""
    matched = view(spark, sf_dir, "files").filter("agent IS NOT NULL").select("commit_id", F.col("agent").alias("conversation_id"))
    none = spark.createDataFrame([], "commit_id long, conversation_id string, lines long")
    links = attribution.links(matched, none).select(F.col("commit_id").alias("id"), F.col("conversation_id").alias("agent"))
    return view(spark, sf_dir, "commits").select("id").join(links, "id").groupBy("id").agg(F.array_sort(F.collect_list("agent")).alias("agents"))


@query("SELECT id, commit_hash FROM (SELECT * FROM v_commits WHERE authored_at < (SELECT min(authored_at) FROM v_commits WHERE authored_at >= 900000000) ORDER BY authored_at DESC, commit_hash DESC LIMIT 50)", "commits")
def slice_before(spark, sf_dir):
    """O12 S29"""
    rows = view(spark, sf_dir, "commits")
    return commits.slice_before(rows, rows.filter("authored_at >= 900000000").select("commit_hash"), 50).select("id", "commit_hash")


def _drained(spark: SparkSession, make: Callable[[DataFrame], DataFrame], sf_dir: str) -> DataFrame:
    """A stream over the events run to its end, with the last state of each key; files go to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = make(ingest.event_stream(spark, sf_dir, schema, "events.parquet"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    ingest.drain(stream, write, f"{folder}/checkpoint", "update")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT user_id AS conversation_id, min(epoch_us(ts) // 1000) AS started_at, max(epoch_us(ts) // 1000) FILTER (event_type IN ('click', 'signup')) AS ended_at, count(*) FILTER (event_type = 'click') AS user_prompt_count FROM events GROUP BY user_id")
def stream_conversation_state(spark, sf_dir):
    """Keyed state without a bound on lateness."""

    def make(events: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "click", "prompt").when(F.col("event_type") == "signup", "answer").otherwise("log")
        return ingest.conversation_state(events.select(F.col("user_id").alias("conversation_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), kind.alias("message_type")))

    out = _drained(spark, make, sf_dir)
    return out.groupBy("conversation_id").agg(F.max_by(F.struct("started_at", "ended_at", "user_prompt_count"), "batch").alias("s")).select("conversation_id", "s.*")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_days(spark, sf_dir):
    """Windows of a day under a watermark that holds all of them."""
    out = _drained(spark, lambda events: ingest.tumbling_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "60 days"), sf_dir)
    return out.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1""")
def stream_sliding_week(spark, sf_dir):
    """T16"""
    out = _drained(spark, lambda events: ingest.sliding_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "60 days"), sf_dir)
    return out.groupBy("window").agg(F.max_by("n", "batch").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


@query(
    f""", {_MEASURED}, d AS (SELECT CAST(unnest(generate_series(DATE '1991-12-01', DATE '1998-12-31', INTERVAL 1 DAY)) AS DATE) AS day),
    s AS (SELECT d.day, count(m.id) FILTER (NOT m.ignored) AS n FROM d LEFT JOIN m ON CAST(to_timestamp(authored_at) AT TIME ZONE 'UTC' AS DATE) = d.day GROUP BY 1),
    l AS (SELECT *, lag(n) OVER (ORDER BY day) AS before FROM s) SELECT strftime(day, '%Y-%m-%d') AS day, n AS n_commits FROM l WHERE NOT (n = 0 AND coalesce(before, 1) = 0)""",
    "commits", "files",
)
def collapse_empty_days(spark, sf_dir):
    """One row for each run of empty days, over all days from before the first commit to after the last."""
    daily = commits.daily_commit_summary(measured_commits(spark, sf_dir), "1991-12-01", "1999-01-01", "UTC")
    return commits.collapse_empty_days(daily).select(F.col("day").cast("string").alias("day"), "n_commits")


@query("SELECT id, commit_hash FROM v_commits WHERE branch_name = 'P' ORDER BY authored_at DESC, commit_hash DESC LIMIT 20", "commits")
def default_slice(spark, sf_dir):
    """The newest 20 commits of a branch, oldest first."""
    return commits.default_slice(commits.filter_commits(view(spark, sf_dir, "commits"), "P")).select("id", "commit_hash")


@query("SELECT id, CASE WHEN authored_at >= 900000000 THEN 0 ELSE coverage_version END AS coverage_version, CASE WHEN id % 6 = 0 THEN id % 4 = 0 ELSE ignored END AS ignored FROM v_commits", "commits")
def reset_and_flags(spark, sf_dir):
    """K12 K14"""
    rows = mutations.reset_versions(view(spark, sf_dir, "commits"), 900_000_000)
    flags = rows.filter("id % 6 = 0").select("id", (F.col("id") % 4 == 0).alias("value"))
    return mutations.set_flags(rows, flags, "ignored").select("id", "coverage_version", "ignored")


@query("""SELECT page_id, regexp_matches(path, '^[^/]*/en/.*$') OR regexp_matches(path, '(^|/)[^/]*\\.html(/|$)') AS hit
    FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)""")  # fmt: skip
def ignored_paths(spark, sf_dir):
    """Globs over paths."""
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", text.ignored_path(path, "*/en/**\n*.html\n", defaults=False).alias("hit"))


_NAMED = """['src/node_modules/a.js', '.git/config', 'a/__pycache__/b.pyc', 'x/.next/y/z', 'app.min.js', 'lib/app.min.css', 'deep/er/yarn.lock', 'Cargo.lock/inner', 'a.map', 'my-package-lock.json', 'go.sums', 'src/main.rs', 'git/config', 'lock', 'pages/' || page_id || '.html']"""


@query(f"SELECT page_id, nth, nth < 9 AS hit, nth < 9 OR nth = 14 AS more FROM (SELECT page_id, unnest(range(len({_NAMED}))) AS nth FROM pages)")
def ignored_by_default(spark, sf_dir):
    """The default list, alone and beside a pattern of one's own."""
    paths = F.array(*[F.expr(e) for e in _NAMED.strip("[]").split(", ")])
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(paths).alias("nth", "path"))
    return rows.select("page_id", F.col("nth").cast("long").alias("nth"), text.ignored_path(F.col("path")).alias("hit"), text.ignored_path(F.col("path"), "pages/*.html").alias("more"))


@query("""SELECT id, CASE WHEN length(t) > 30 THEN t[1:30] || '...' ELSE t END AS title, CASE WHEN length(p) > 40 THEN p[1:40] || '…' ELSE p END AS preview
    FROM (SELECT id, trim(content) AS t, trim(regexp_replace(content, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS p FROM v_corpus)""", "corpus")  # fmt: skip
def titles(spark, sf_dir):
    """F19 F39"""
    return view(spark, sf_dir, "corpus").select("id", text.title(F.col("content"), 30).alias("title"), text.preview(F.col("content"), 40).alias("preview"))


@query("SELECT id FROM v_corpus WHERE contains(lower(content), 'license')", "corpus")
def search_by_trigrams(spark, sf_dir):
    """Q02 Q05: documents that hold all trigrams of a term, then the term itself."""
    rows = view(spark, sf_dir, "corpus").select("id", "content")
    term = "license"
    wanted = [term[i : i + 3] for i in range(len(term) - 2)]
    index = search.trigram_index(rows, "id", "content").filter(F.col("trigram").isin(wanted))
    full = index.groupBy("id").agg(F.countDistinct("trigram").alias("n")).filter(F.col("n") == len(set(wanted)))
    return rows.join(full, "id", "left_semi").filter(search.contains([F.col("content")], term)).select("id")


@query("SELECT temp AS temp_conversation_id, arg_max(conversation_id, (created_at, seq)) AS conversation_id FROM (SELECT *, 't' || (id % 13) AS temp FROM v_ratings) GROUP BY 1", "ratings")
def resolved_aliases(spark, sf_dir):
    """J22 W02"""
    return conversations.resolve_alias(view(spark, sf_dir, "ratings").withColumn("temp_conversation_id", F.concat(F.lit("t"), F.col("id") % 13)))


@query("SELECT id, id % 40 + id % 90 <= 100 AS valid FROM v_commits", "commits")
def valid_overrides(spark, sf_dir):
    """K13 F12"""
    percents = F.create_map(F.lit("alpha"), (F.col("id") % 40).cast("int"), F.lit("beta"), (F.col("id") % 90).cast("int"))
    return view(spark, sf_dir, "commits").select("id", commits.valid_override(percents).alias("valid"))


@query("""SELECT git_id, list_sort(list(id)) AS ids FROM v_projects GROUP BY git_id""", "projects")
def project_groups(spark, sf_dir):
    """J17"""
    return projects.groups(view(spark, sf_dir, "projects"))


@query("SELECT conv_id, list_sort(list(DISTINCT role)) AS roles, max(turn) - min(turn) AS span FROM v_turns GROUP BY conv_id", "turns")
def conversation_spans(spark, sf_dir):
    """G31 G33"""
    return conversations.run_spans(view(spark, sf_dir, "turns"), "conv_id", "turn", "role").withColumnRenamed("values", "roles")


from . import queries_more as _more  # noqa: E402, F401  registers the further queries
from . import queries_attribution as _attribution  # noqa: E402, F401
from . import queries_payload_files as _payload_files  # noqa: E402, F401
from . import queries_streams as _streams  # noqa: E402, F401
