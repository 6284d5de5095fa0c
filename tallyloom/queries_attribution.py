"""Queries of the attribution over lines of the corpus that were broken otherwise, quoted otherwise, removed, moved between files or written long ago, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import view
from .functions import diffs, text
from .operators import attribution
from .plans import api
from .queries import query

#: Odd documents are messages, the even ones after them commits; both at six hours a document, so a window holds 28.
HOURS = 6


def _tokens(rows: DataFrame, owner: str) -> DataFrame:
    """Tokens of (owner, position, path, sign, line)."""
    out = rows.withColumns({"norm": text.strip_space(F.col("line")), "position": F.col("position").cast("int")})
    out = out.withColumns({"style": diffs.style_norm(F.col("line"), F.col("path")), "keys": text.match_keys(F.col("path"), F.col("sign"), F.col("norm")), "attributable": text.attributable(F.col("norm"))})
    return out.filter(text.has_text(F.col("line"))).withColumn(owner, F.col(owner).cast("string"))


def _message(rows: DataFrame, n: str = "n") -> DataFrame:
    return rows.withColumns({"conversation_id": F.concat(F.lit("c"), F.col(n) % 50), "agent": F.concat(F.lit("a"), F.col(n) % 3), "timestamp": F.col(n) * (HOURS * 3_600_000)})


def _commits(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("commit_id").alias("id"), (F.col("n") * (HOURS * 3600)).alias("authored_at")).distinct()


def _corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "corpus").select(F.col("id").alias("n"), F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("position", "line"))


_LINES = "t AS (SELECT id AS n, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) - 1 AS position, unnest(string_split(coalesce(content, ''), chr(10))) AS line FROM v_corpus)"


@query(
    f""", {_LINES}, h AS (SELECT *, length(line) // 2 AS half FROM t WHERE length(line) >= 40), b AS (SELECT *, half + strpos(substr(line, half + 1), ' ') AS cut FROM h WHERE strpos(substr(line, half + 1), ' ') > 0)
    SELECT CAST(n AS VARCHAR) AS commit_id, CAST(n AS VARCHAR) || 'm' AS message_id, 'formatting' AS pass, 2 * count(*) AS lines FROM b
    WHERE regexp_matches(substr(line, 1, cut), '[\\p{{L}}\\p{{Nd}}]') GROUP BY n""",
    "corpus",
)
def formatting_windows(spark, sf_dir):
    """Every line of a document is a message's, broken in two by a commit of the same file."""
    half = F.floor(F.length("line") / 2).cast("int")
    rows = _corpus_lines(spark, sf_dir).filter("length(line) >= 40").withColumn("cut", half + F.instr(F.substr("line", half + 1), " ")).filter(F.col("cut") > half)
    # the number of a line at its end keeps a half from being another line
    path, sign, mark = F.concat(F.lit("src/"), F.col("n"), F.lit("/main.js")), F.lit("+"), F.concat(F.lit(" #"), F.col("position"))
    theirs = _message(_tokens(rows.select(F.concat("n", F.lit("m")).alias("message_id"), "n", "position", path.alias("path"), sign.alias("sign"), F.concat("line", mark).alias("line")), "message_id"))
    halves = F.posexplode(F.array(F.substr("line", F.lit(1), F.col("cut")), F.concat(F.substr("line", F.col("cut") + 1), mark)))
    mine = rows.select(F.col("n").alias("commit_id"), "n", "position", "line", "cut", halves.alias("half", "part"))
    mine = _tokens(mine.select("commit_id", "n", (F.col("position") * 2 + F.col("half")).alias("position"), path.alias("path"), sign.alias("sign"), F.col("part").alias("line")), "commit_id")
    return attribution.match_lines(_commits(mine), mine, theirs).groupBy("commit_id", "message_id", "pass").agg(F.count(F.lit(1)).alias("lines"))


@query(
    f""", {_LINES}, c AS (SELECT n, count(*) AS lines FROM t GROUP BY n)
    SELECT CAST(n AS VARCHAR) AS commit_id, CAST(n AS VARCHAR) || 'old' AS message_id, 'style' AS pass, lines FROM c WHERE n % 3 <> 0 UNION ALL SELECT CAST(n AS VARCHAR), CAST(n AS VARCHAR) || 'old', 'exact', 3 FROM c""",
    "corpus",
)
def quote_styles(spark, sf_dir):
    """Lines quoted otherwise, in files where that is style; the conversation that wrote the file's equal lines gives them, though another one wrote them later."""
    clean = F.regexp_replace(F.coalesce("line", F.lit("")), "[\"'`\\\\\\\\]", "")
    path = F.concat(F.lit("src/"), F.col("n"), F.when(F.col("n") % 3 == 0, "/main.py").otherwise("/main.js"))
    rows = _corpus_lines(spark, sf_dir).select("n", (F.col("position") + 10).alias("position"), clean.alias("line"), path.alias("path"), F.lit("+").alias("sign"))
    heads = view(spark, sf_dir, "corpus").select(F.col("id").alias("n"), F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("position"), path.alias("path"), F.lit("+").alias("sign"))
    heads = heads.withColumn("line", F.concat(F.lit("let head"), "position", F.lit(" = "), "n"))
    single = rows.withColumn("line", F.concat(F.lit("say('"), "line", F.lit("');")))
    double = rows.withColumn("line", F.concat(F.lit('say("'), "line", F.lit('");')))
    old = heads.unionByName(single).withColumns({"message_id": F.concat("n", F.lit("old")), "m": F.col("n") * 2})
    new = single.withColumns({"message_id": F.concat("n", F.lit("new")), "m": F.col("n") * 2 + 1})
    theirs = _message(_tokens(old.unionByName(new), "message_id"), "m").withColumn("timestamp", F.expr("timestamp div 2"))
    mine = _tokens(heads.unionByName(double).withColumn("commit_id", F.col("n")), "commit_id")
    commits = _commits(mine).withColumn("authored_at", F.col("authored_at") + HOURS * 3600)
    return attribution.match_lines(commits, mine, theirs).groupBy("commit_id", "message_id", "pass").agg(F.count(F.lit(1)).alias("lines"))


def _removed_and_added(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Commits, their tokens and message tokens over the corpus: a line's text sets its file (of 256) and whether it is removed or added; look-back binds."""
    digest = F.md5(text.strip_space(F.col("line")))
    rows = _corpus_lines(spark, sf_dir).select("n", "position", "line", F.concat(F.lit("src/"), F.substring(digest, 1, 2), F.lit("/a/file.js")).alias("path"), F.when(F.substring(digest, 3, 1) < "5", "-").otherwise("+").alias("sign"))
    mine = _tokens(rows.filter("n % 2 = 0").withColumn("commit_id", F.col("n")), "commit_id").filter("attributable")
    theirs = _message(_tokens(rows.filter("n % 2 = 1").withColumn("message_id", F.col("n")), "message_id")).filter("attributable")
    return _commits(mine), mine, theirs


_BOUND = f""", {_LINES}, s AS (SELECT n AS id, position, regexp_replace(line, '[ \t\r\n]', '', 'g') AS norm FROM t WHERE regexp_matches(line, '[\\p{{L}}\\p{{Nd}}]')),
    a AS (SELECT *, row_number() OVER (PARTITION BY id, norm ORDER BY position) AS k FROM s WHERE id % 2 = 0), b AS (SELECT * FROM s WHERE id % 2 = 1),
    x AS (SELECT w.id, w.norm, b.id AS message, row_number() OVER (PARTITION BY w.id, w.norm ORDER BY b.id DESC, b.position) AS k FROM (SELECT DISTINCT id, norm FROM a) w JOIN b ON b.norm = w.norm AND b.id > w.id - 28 AND b.id <= w.id),
    e AS (SELECT a.id, a.position, a.norm, x.message FROM a JOIN x USING (id, norm, k))"""


@query(_BOUND + " SELECT CAST(id AS VARCHAR) AS commit_id, CAST(position AS INT) AS position, CAST(message AS VARCHAR) AS message_id, CASE WHEN substr(md5(norm), 3, 1) < '5' THEN '-' ELSE '+' END AS sign FROM e", "corpus")
def exact_pass_in_window(spark, sf_dir):
    """Added and removed lines, only of messages within seven days."""
    return attribution.match_lines(*_removed_and_added(spark, sf_dir)).filter("pass = 'exact'").select("commit_id", "position", "message_id", "sign")


@query(
    _BOUND + """, w AS (SELECT DISTINCT id, norm FROM a), u AS (SELECT id, norm, 'c' || (message % 50) AS conversation_id, count(*) AS used FROM e GROUP BY ALL),
    n AS (SELECT w.id, w.norm, 'c' || (b.id % 50) AS conversation_id, min('a' || (b.id % 3)) AS agent, count(*) AS n FROM w JOIN b ON b.norm = w.norm AND b.id > w.id - 28 AND b.id <= w.id GROUP BY ALL)
    SELECT CAST(id AS VARCHAR) AS commit_id, md5(norm) AS norm, 'src/' || substr(md5(norm), 1, 2) || '/a/file.js' AS path, conversation_id, agent, n - coalesce(used, 0) AS n FROM n LEFT JOIN u USING (id, norm, conversation_id) WHERE n > coalesce(used, 0)""",
    "corpus",
)
def supply_of_texts(spark, sf_dir):
    """What the messages of a commit's window hold of its texts beyond what the passes have used, from counts by day."""
    commits, mine, theirs = _removed_and_added(spark, sf_dir)
    matched = attribution.match_lines(commits, mine, theirs).filter("pass = 'exact'")
    supply = attribution.norm_supply(commits, mine.select("commit_id", "norm").distinct(), theirs, matched)
    return supply.select("commit_id", F.md5("norm").alias("norm"), "path", "conversation_id", "agent", "n")


@query(
    _BOUND + """, d AS (SELECT a.id, substr(md5(a.norm), 1, 2) AS path, substr(md5(a.norm), 3, 1) < '5' AS gone, e.message IS NOT NULL AS matched FROM a LEFT JOIN e ON a.id = e.id AND a.position = e.position WHERE substr(md5(a.norm), 1, 1) <> '0'),
    f AS (SELECT id, path, count(*) AS n, count(*) FILTER (NOT gone) AS added, count(*) FILTER (matched) AS matched FROM d GROUP BY id, path),
    m AS (SELECT id, sum(matched) AS matched, sum(CASE WHEN matched = 0 AND added = 0 THEN n ELSE 0 END) AS deleted, sum(n) AS total FROM f GROUP BY id)
    SELECT CAST(id AS VARCHAR) AS commit_id, CAST(total AS BIGINT) AS lines_total, CAST(CASE WHEN id % 6 <> 0 AND matched > 0 THEN matched + deleted ELSE 0 END AS BIGINT) AS lines_from_agent FROM m""",
    "corpus",
)
def recomputed_commits(spark, sf_dir):
    """Only commits of the local user are attributed, ignored files count nowhere, and files that were only removed from follow the commit's conversation."""
    commits, mine, theirs = _removed_and_added(spark, sf_dir)
    commits = commits.withColumn("user_email", F.when(F.col("id").cast("long") % 6 == 0, "someone@else.org").otherwise("Me@Here.org"))
    files = mine.groupBy("commit_id", "path").agg(F.count_if("attributable").alias("lines_total")).withColumns({"ignored": F.col("path").startswith("src/0"), "moved": F.lit(False)})
    return api.recompute_coverage(commits, mine, theirs, ["me@here.org"], files)["commits"]
