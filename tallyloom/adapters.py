"""The domain tables as views of the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import ship

#: {ms} and {seconds} are the engine's own expressions; other braces are tables.
VIEWS = {
    "projects": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS label, '/work/' || lower(n_name) AS path, CAST(n_regionkey AS BIGINT) AS git_id, n_nationkey % 10 = 9 AS ignored FROM {nation}",
    "messages": """SELECT event_id AS id, {ms} AS timestamp, CAST((user_id - user_id % 5) / 5 AS BIGINT) % 25 AS project_id, user_id AS conversation_id,
        CASE WHEN event_type IN ('click', 'signup') THEN 'user' ELSE 'agent' END AS role,
        CASE event_type WHEN 'click' THEN 'prompt' WHEN 'signup' THEN 'answer' WHEN 'purchase' THEN 'final_answer' WHEN 'error' THEN 'diff' ELSE 'log' END AS message_type,
        CASE WHEN event_id % 3 = 0 THEN 'm' || (event_id % 7) END AS model, props AS content FROM {events}""",
    "conversations": """SELECT DISTINCT user_id AS id, CAST((user_id - user_id % 5) / 5 AS BIGINT) % 25 AS project_id,
        CASE user_id % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 2 THEN 'gamma' ELSE 'delta' END AS agent,
        CASE WHEN user_id % 5 IN (1, 2) THEN user_id - 1 END AS parent_conversation_id, user_id - CASE WHEN user_id % 5 IN (1, 2) THEN user_id % 5 ELSE 0 END AS family_root_id,
        user_id % 11 = 0 AS hidden FROM {events}""",
    "ratings": """SELECT doc_id AS id, doc_id AS seq, doc_id % 150 AS conversation_id, CAST(quality * 4 + (1 - toxic) AS INT) AS rating, 'n' || (doc_id % 7) AS note,
        1704067200000 + doc_id * 60000 AS created_at FROM {labels}""",
    "commits": """SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS project_id, o_orderstatus AS branch_name, 'h' || o_orderkey AS commit_hash, o_orderpriority AS subject, c_name AS user_name,
        'u' || c_custkey AS user_email, {seconds} AS authored_at, o_orderkey % 17 = 0 AS ignored, CAST(o_orderkey % 3 AS INT) AS coverage_version FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "files": """SELECT l_orderkey AS commit_id, p_brand || '/' || p_name || '.' || p_type AS path, CAST(l_quantity AS BIGINT) AS lines,
        CASE l_returnflag WHEN 'A' THEN 'alpha' WHEN 'R' THEN 'beta' END AS agent, l_linenumber % 7 = 0 AS ignored FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "turns": "SELECT conv_id, turn, role, text FROM {conversations}",
    "corpus": "SELECT doc_id AS id, doc_id % 25 AS project_id, text AS content, source FROM {documents}",
}
SPARK = {"ms": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000", "seconds": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) div 1000000"}
DUCK = {"ms": "epoch_us(ts) // 1000", "seconds": "epoch_us(o_orderdate) // 1000000"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    for key, value in SPARK.items():
        sql = sql.replace(f"{{{key}}}", value)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in sql})


def oracle(sql: str, *names: str) -> str:
    """sql over the views `v_<name>`, as one DuckDB statement."""
    if not names:
        return sql
    parts = [f"v_{name} AS ({VIEWS[name].format(**DUCK, **{t: t for t in TABLES})})" for name in names]
    recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
    return f"WITH {recursive}{', '.join(parts)} {sql.replace('RECURSIVE', '')}"
