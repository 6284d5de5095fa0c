"""Queries of files that payloads hold, made of the documents' own texts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import table
from .functions import diffs
from .operators import diff_merge, payload_files
from .queries import query

# lines of a text without the empty one at its end, and the diff that adds them
_LINES = """d AS (SELECT doc_id, text, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS lines, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS n_full FROM documents WHERE regexp_matches(text, '\\S'))"""
_ADDED = "regexp_replace('diff --git a/{path} b/{path}' || chr(10) || '--- /dev/null' || chr(10) || '+++ b/{path}' || chr(10) || '@@ -0,0 +1,' || len(lines) || ' @@' || chr(10) || array_to_string(list_transform(lines, lambda x: '+' || x), chr(10)), '\\s+$', '')"


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each document: its text as numbered lines, as read, as edited, beside a patch, or in the call of a tool."""
    i, t = F.col("doc_id"), F.col("text")
    file = lambda **more: F.struct(F.concat(F.lit("/work/repo/src/f"), i, F.lit(".txt")).alias("filePath"), *[c.alias(k) for k, c in more.items()])
    lines = F.split(t, "\n")
    numbered = F.array_join(F.transform(lines, lambda x, k: F.when(F.regexp_like(x, F.lit(r"\S")), F.concat(F.lit("  "), k + 1, F.lit("\t"), x)).otherwise(x)), "\n")
    patch = F.array(F.struct(F.lit(2).alias("oldStart"), F.lit(1).alias("oldLines"), F.lit(2).alias("newStart"), F.lit(1).alias("newLines"), F.array(F.lit("-old"), F.concat(F.lit("+"), F.get(lines, F.lit(0)))).alias("lines")))
    kinds = [
        F.to_json(F.struct(F.lit("/work/repo").alias("cwd"), file(content=numbered, numLines=F.lit(3)).alias("toolUseResult"))),
        F.to_json(F.struct(F.lit("/work/repo").alias("cwd"), file(content=t, numLines=F.lit(3)).alias("toolUseResult"))),
        F.to_json(F.struct(F.lit("/elsewhere").alias("cwd"), F.array(file(content=t, userModified=F.lit(False))).alias("results"))),
        F.to_json(F.struct(F.lit("/work/repo/src").alias("cwd"), file(content=t, structuredPatch=patch).alias("a"), file(content=t, newString=F.lit("")).alias("b"))),
        F.to_json(F.struct(F.lit("tool_use").alias("type"), file(content=t, newString=F.lit("")).alias("input"))),
    ]
    raw = F.when(i % 5 == 0, kinds[0]).when(i % 5 == 1, kinds[1]).when(i % 5 == 2, kinds[2]).when(i % 5 == 3, kinds[3]).otherwise(kinds[4])
    return table(spark, sf_dir, "documents").select(i.cast("string").alias("id"), raw.alias("raw_json"))


@query(
    f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS id, 'file' AS kind, {_ADDED.format(path="src/f' || doc_id || '.txt")} AS diff FROM d WHERE doc_id % 5 = 2 OR (doc_id % 5 = 0 AND n_full >= 3)
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'patch', regexp_replace('diff --git a/src/f' || doc_id || '.txt b/src/f' || doc_id || '.txt' || chr(10) || '--- a/src/f' || doc_id || '.txt' || chr(10) || '+++ b/src/f' || doc_id || '.txt' || chr(10)
      || '@@ -2,1 +2,1 @@' || chr(10) || '-old' || chr(10) || '+' || string_split(text, chr(10))[1], '\\s+$', '') FROM documents WHERE doc_id % 5 = 3 AND text IS NOT NULL"""
)
def payload_file_diffs(spark, sf_dir):
    """Patches before whole files; files only read and calls of tools give none; paths below the repository."""
    roots = spark.createDataFrame([("/work/repo",), ("/work/repo/sub",)], "root string")
    return payload_files.file_diffs(_payloads(spark, sf_dir), "id", roots=roots).select("id", "kind", "diff")


@query(
    f"""WITH {_LINES} SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN octet_length(encode(a)) >= octet_length(encode(b)) THEN 'one.txt' ELSE 'two.txt' END AS path, CASE WHEN octet_length(encode(a)) >= octet_length(encode(b)) THEN a ELSE b END AS diff
    FROM (SELECT doc_id, {_ADDED.format(path="one.txt")} AS a, {_ADDED.format(path="two.txt").replace("lines", "half")} AS b FROM (SELECT *, list_transform(lines[:(len(lines) + 1) // 2], lambda x: x || x || '!') AS half FROM d))"""
)
def largest_payload_diff(spark, sf_dir):
    """Of two files in a payload the larger diff."""
    t = F.col("text")
    lines = F.split(t, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    half = F.array_join(F.transform(F.slice(lines, F.lit(1), F.floor((F.size(lines) + 1) / 2).cast("int")), lambda x: F.concat(x, x, F.lit("!"))), "\n")
    file = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"), F.lit(1).alias("newLines"))
    raw = F.to_json(F.struct(file("one.txt", t).alias("a"), F.array(file("two.txt", half)).alias("b")))
    rows = table(spark, sf_dir, "documents").filter(F.regexp_like("text", F.lit(r"\S"))).select(F.col("doc_id").cast("string").alias("id"), raw.alias("raw_json"))
    return payload_files.largest_diff(payload_files.file_diffs(rows, "id"), "id")


@query("SELECT doc_id % 7 AS conversation_id, doc_id AS timestamp, 's' || (doc_id % 3) AS session, 'f' || (doc_id % 4) AS path, replace(text, chr(13) || chr(10), chr(10)) AS content, CASE WHEN doc_id % 2 = 0 THEN 'before' ELSE '' END AS original, doc_id % 6 = 0 AS is_create FROM documents WHERE regexp_matches(text, '\\S')")
def write_snapshots(spark, sf_dir):
    """Whole files that payloads wrote, by the result of a tool or, every third, by its call."""
    i, t = F.col("doc_id"), F.col("text")
    path, session = F.concat(F.lit("f"), i % 4), F.concat(F.lit("s"), i % 3)
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("Write").alias("name"), F.struct(path.alias("file_path"), t.alias("content")).alias("input"))
    inside = F.struct(F.struct(path.alias("filePath"), t.alias("content")).alias("file"), F.when(i % 6 == 0, "create").otherwise("text").alias("type"), F.when(i % 2 == 0, "before").alias("originalFile"))
    by_call = F.struct(F.when(i % 6 == 0, "create").otherwise("text").alias("type"), F.when(i % 2 == 0, "before").alias("originalFile"))
    raw = F.when(i % 3 == 1, F.to_json(F.struct(session.alias("sessionId"), by_call.alias("toolUseResult"), F.struct(F.array(call).alias("content")).alias("message"))))
    raw = raw.otherwise(F.to_json(F.struct(session.alias("sessionId"), inside.alias("toolUseResult"))))
    rows = table(spark, sf_dir, "documents").select((i % 7).alias("conversation_id"), i.alias("timestamp"), i.cast("string").alias("id"), raw.alias("raw_json"))
    return payload_files.written_files(rows).select("conversation_id", "timestamp", "session", "path", "content", "original", "is_create")


@query(
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT *, len(l) // 3 + 1 AS a, len(l) // 2 + 2 AS b FROM d WHERE len(l) >= 6)
    SELECT CAST(doc_id AS VARCHAR) AS conversation_id, 'f' || doc_id AS file, '@@ -0,0 +1,1 @@' || chr(10) || '+top' || chr(10) || '@@ -' || a || ',1 +' || (a + 1) || ',2 @@' || chr(10) || '-' || l[a] || chr(10) || '+one' || chr(10) || '+TWO' || chr(10)
      || '@@ -' || b || ',1 +' || (b + 1) || ',0 @@' || chr(10) || '-' || l[b] || chr(10) AS merged, CAST(3 AS BIGINT) AS n FROM k"""
)
def merged_file_diffs(spark, sf_dir):
    """Three edits of a document, each against the state after the one before, as one diff against the first state."""
    i = F.col("doc_id").cast("string")
    rows = table(spark, sf_dir, "documents").withColumn("l", F.split("text", "\n")).filter(F.size("l") >= 6)
    rows = rows.withColumns({"a": F.floor(F.size("l") / 3).cast("int") + 1, "b": F.floor(F.size("l") / 2).cast("int") + 2})
    line = lambda k: F.get("l", F.col(k) - 1)
    hunks = [
        F.concat(F.lit("@@ -"), "a", F.lit(",1 +"), "a", F.lit(",2 @@\n-"), line("a"), F.lit("\n+one\n+two\n")),
        F.concat(F.lit("@@ -0,0 +1,1 @@\n+top\n@@ -"), F.col("b") + 1, F.lit(",1 +"), F.col("b") + 1, F.lit(",0 @@\n-"), line("b"), F.lit("\n")),
        F.concat(F.lit("@@ -"), F.col("a") + 2, F.lit(",1 +"), F.col("a") + 2, F.lit(",1 @@\n-two\n+TWO\n")),
    ]
    head = F.concat(F.lit("diff --git a/f"), i, F.lit(" b/f"), i, F.lit("\n--- a/f"), i, F.lit("\n+++ b/f"), i, F.lit("\n"))
    each = rows.select(i.alias("conversation_id"), F.posexplode(F.array(*[F.concat(head, h) for h in hunks])).alias("timestamp", "content")).withColumn("id", F.col("timestamp"))
    return diff_merge.merge_by_file(each)


@query(
    """WITH d AS (SELECT doc_id, 'g' || doc_id || '.txt' AS f, string_split(text || chr(10) || 'end', chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT *, array_to_string(list_transform(l, lambda x: '+' || x), chr(10)) || chr(10) AS body FROM d)
    SELECT doc_id AS id, 'diff --git a/' || f || ' b/' || f || chr(10) || '--- /dev/null' || chr(10) || '+++ b/' || f || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '@@ -0,0 +1 @@' ELSE '@@ -0,0 +1,' || len(l) || ' @@' END || chr(10) || body AS diff FROM b"""
)
def written_texts(spark, sf_dir):
    """Documents as messages that write them: a patch that adds the file, a heredoc of a shell, or the log of a created file."""
    i, f = F.col("doc_id"), F.concat(F.lit("g"), F.col("doc_id"), F.lit(".txt"))
    body = F.concat("text", F.lit("\nend"))
    patch = F.concat(F.lit("Now:\n*** Begin Patch\n*** Add File: "), f, F.lit("\n"), F.array_join(F.transform(F.split(body, "\n"), lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n*** End Patch\n"))
    heredoc = F.concat(F.lit("cat > "), f, F.lit(" <<'EOF_OF_IT'\n"), body, F.lit("\nEOF_OF_IT\n"))
    created = F.concat(F.lit("File created successfully at: "), f, F.lit("\n"), body)
    said = F.when(i % 3 == 0, patch).when(i % 3 == 1, heredoc).otherwise(created)
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(i.alias("id"), diffs.reliable_diff_column(said).alias("diff"))
