"""Diffs of files that raw payloads hold: the JSON is walked as variants, candidates are rows, and every rule is a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.diffs import LEAST_LINES, MUTATION_KEYS, NUMBER, NUMBERED_PERCENT
from ..session import stored

# Where payloads name a file and its content.
PATH_KEYS = ("filePath", "file_path", "path")
CONTENT_KEYS = ("content", "fileContent", "file_content", "text")
#: What patterns call space.
SPACE = " \t\n\x0b\f\r"
#: Folders with a known repository up to which they are broadcast; beyond it the joins shuffle.
BROADCAST_FOLDERS = 500_000


def field(node: Column, *path: str) -> Column:
    """The variant at a path of keys; null if there is none."""
    return F.try_variant_get(node, "$" + "".join(f".{k}" for k in path), "variant")


def has_key(node: Column, key: str) -> Column:
    return field(node, key).isNotNull()


def text_at(node: Column, *path: str) -> Column:
    """The string at a path; null for what isn't a string."""
    value = field(node, *path)
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def _not_blank(text: Column) -> Column:
    """text without space around it, null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def objects(payloads: DataFrame, key: str, raw: str = "raw_json") -> DataFrame:
    """(key, place, cwd, node): every JSON object of the payloads, with its place in them (comparable, keys in order) and the working folder it inherits.

    One round opens all objects and arrays of a level, so there are as many rounds as
    the deepest payload has levels, each a map without shuffle. Calls of tools are left
    out with all they hold: their results say what was done.
    """
    none = F.array().cast("array<int>")
    level = payloads.select(F.col(key).alias("key"), none.alias("place"), F.lit("").alias("cwd"), F.try_parse_json(raw).alias("node")).filter("node IS NOT NULL")
    found = []
    while True:
        kind = F.schema_of_variant("node")
        level = level.withColumn("is_object", kind.startswith("OBJECT")).filter(F.col("is_object") | kind.startswith("ARRAY"))
        level = level.withColumn("cwd", F.when(F.col("is_object"), F.coalesce(_not_blank(text_at(F.col("node"), "cwd")), "cwd")).otherwise(F.col("cwd")))
        level = stored(level.filter(~F.coalesce(F.col("is_object") & (text_at(F.col("node"), "type") == "tool_use"), F.lit(False))))
        if not level.limit(1).count():
            break
        found.append(level.filter("is_object").drop("is_object"))
        level = level.sparkSession.sql("SELECT t.key, array_append(t.place, e.pos) AS place, t.cwd, e.value AS node FROM {level} AS t, LATERAL variant_explode(t.node) AS e", level=level)
    out = reduce(DataFrame.unionByName, found) if found else level.drop("is_object")
    return out.withColumnRenamed("key", key) if key != "key" else out


def _normal(path: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(F.translate(path, "\\", "/")), r"^\./", ""), "^/", ""), F.lit(""))


def _below(base: Column, path: Column) -> Column:
    """path relative to base; null if it doesn't lie below."""
    folder = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when((F.trim(base) != "") & path.startswith(folder) & (F.length(path) > F.length(folder)), F.substr(path, F.length(folder) + 1))


def path_candidates(path: Column, cwd: Column, cwd_root: Column, path_root: Column) -> Column:
    """The paths that a payload's file may have within its repository, the likeliest first.

    A relative path stands as it is; an absolute one is cut at the repository of the
    working folder, the working folder, or its own repository, and stays whole last.
    """
    path = F.trim(path)
    absolute = F.regexp_replace(path, "/+", "/")
    whole = F.array(_below(cwd_root, absolute), _below(cwd, absolute), _below(path_root, absolute), absolute)
    joined = lambda base: F.when(F.trim(base) != "", F.concat_ws("/", F.regexp_replace(base, "/+$", ""), path))
    relative = F.array(path, joined(cwd), joined(cwd_root))
    return F.array_distinct(F.array_compact(F.transform(F.when(path.startswith("/"), whole).otherwise(relative), _normal)))


def nearest_roots(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(folder, root): the innermost of the repositories `roots` (root) that a folder lies in, by an equi join on the folder's prefixes."""
    parts = F.split("folder", "/")
    prefixes = folders.select("folder").distinct().withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    known = roots.select(F.regexp_replace("root", "/+$", "").alias("root")).distinct()
    return prefixes.join(known, "root").groupBy("folder").agg(F.max_by("root", F.length("root")).alias("root"))


def with_snapshot_diff(rows: DataFrame) -> DataFrame:
    """rows (node, path) with `whole`: the diff that adds a file as an object shows it, or null: what an agent only read wasn't written by it.

    Either the object has a key of an edit, or its lines are numbered, which a read
    file's in plain content aren't; numbers are taken off. Each step is a column of its
    own, so that a text is split once.
    """
    node, lines = F.col("node"), F.col("__lines")
    full = lambda x: F.ltrim(x, F.lit(SPACE)) != ""
    rows = rows.withColumn("__lines", F.split(_unix_lines(F.coalesce(*[text_at(node, k) for k in CONTENT_KEYS])), "\n", -1))
    rows = rows.withColumn("__lines", F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines))
    rows = rows.withColumns({"__full": F.size(F.filter(lines, full)), "__voted": F.size(F.filter(lines, lambda x: full(x) & F.regexp_like(x, F.lit(NUMBER)))), "__edited": reduce(Column.__or__, [has_key(node, k) for k in MUTATION_KEYS])})
    numbered = (F.col("__full") >= LEAST_LINES) & (F.col("__voted") * 100 >= F.col("__full") * NUMBERED_PERCENT)
    body = F.when(numbered, F.transform(lines, lambda x: F.concat(F.lit("+"), F.when(full(x), F.regexp_replace(x, NUMBER, "")).otherwise(x)))).otherwise(F.transform(lines, lambda x: F.concat(F.lit("+"), x)))
    path = F.col("path")
    diff = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines), F.lit(" @@\n"), F.array_join(body, "\n"))
    return rows.withColumn("whole", F.when((F.col("__full") > 0) & (numbered | F.col("__edited")), F.rtrim(diff, F.lit(SPACE)))).drop("__lines", "__full", "__voted", "__edited")


def with_patch_diff(rows: DataFrame) -> DataFrame:
    """rows (node, path) with `patch`: the diff of an object's hunks, or null if no hunk has a changed line."""

    def one(h: Column) -> Column:
        lines = F.try_variant_get(h, "$.lines", "array<string>")
        shown = F.transform(lines, lambda x: F.when(x.startswith(" ") | x.startswith("+") | x.startswith("-"), x).otherwise(F.concat(F.lit(" "), x)))
        number = lambda key, default: F.coalesce(F.try_variant_get(h, f"$.{key}", "int"), F.lit(default))
        head = F.concat(F.lit("@@ -"), number("oldStart", 1), F.lit(","), number("oldLines", 0), F.lit(" +"), number("newStart", 1), F.lit(","), number("newLines", 0), F.lit(" @@\n"))
        return F.struct(F.concat(head, F.array_join(shown, "\n")).alias("text"), F.exists(lines, lambda x: x.startswith("+") | x.startswith("-")).alias("changed"), F.size(lines).alias("n"))

    rows = rows.withColumn("__hunks", F.filter(F.transform(F.try_variant_get("node", "$.structuredPatch", "array<variant>"), one), lambda h: h["n"] > 0))
    path, hunks = F.col("path"), F.col("__hunks")
    diff = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n"), F.array_join(F.transform(hunks, lambda h: h["text"]), "\n"))
    return rows.withColumn("patch", F.when(F.exists(hunks, lambda h: h["changed"]), F.rtrim(diff, F.lit(SPACE)))).drop("__hunks")


def file_diffs(payloads: DataFrame, key: str, raw: str = "raw_json", roots: DataFrame | None = None) -> DataFrame:
    """(key, place, kind, path, diff): patches and whole files that payloads hold, each diff once in a payload, at its first place.

    Whole files count only in payloads without a patch. roots: (root), the folders of
    known repositories, by which absolute paths are cut. Objects stay where they are
    until they are diffs, which are dealt by payload: a folder that most files lie in
    is joined from a broadcast, unless there are too many folders for one.
    """
    named = objects(payloads, key, raw).withColumn("file", F.coalesce(*[_not_blank(text_at(F.col("node"), k)) for k in PATH_KEYS])).filter("file IS NOT NULL")
    named = named.withColumn("folder", F.when(F.col("file").startswith("/"), F.regexp_extract("file", r"^(.*)/", 1)))
    none = F.lit(None).cast("string")
    if roots is None:
        rooted = named.withColumns({"cwd_root": none, "path_root": none})
    else:
        known = stored(nearest_roots(named.select(F.explode(F.array("cwd", "folder")).alias("folder")).filter("folder != ''"), roots))
        known = F.broadcast(known) if known.limit(BROADCAST_FOLDERS + 1).count() <= BROADCAST_FOLDERS else known
        rooted = named.join(known.select(F.col("folder").alias("cwd"), F.col("root").alias("cwd_root")), "cwd", "left").join(known.select("folder", F.col("root").alias("path_root")), "folder", "left")
    rooted = rooted.withColumn("path", F.get(path_candidates(F.col("file"), F.col("cwd"), F.col("cwd_root"), F.col("path_root")), F.lit(0))).filter("path IS NOT NULL")
    each = with_snapshot_diff(with_patch_diff(rooted.select(key, "place", "path", "node"))).drop("node")
    kinds = F.array(F.struct(F.lit("patch").alias("kind"), F.col("patch").alias("diff")), F.struct(F.lit("file").alias("kind"), F.col("whole").alias("diff")))
    rows = each.select(key, "place", "path", F.explode(kinds).alias("k")).select(key, "place", "path", "k.*").filter("diff IS NOT NULL")
    first = rows.repartition(key).groupBy(key, "kind", "diff").agg(F.min(F.struct("place", "path")).alias("at"))
    kept = first.withColumn("patched", F.max(F.col("kind") == "patch").over(W.partitionBy(key))).filter("kind = 'patch' OR NOT patched")
    return kept.select(key, "at.place", "kind", "at.path", "diff")


def largest_diff(found: DataFrame, key: str) -> DataFrame:
    """(key, path, diff): of each payload's diffs the longest, of equally long ones the first."""
    size = F.struct((-F.octet_length("diff")).alias("n"), "place")
    return found.groupBy(key).agg(F.min_by(F.struct("path", "diff"), size).alias("b")).select(key, "b.*")


def written_files(messages: DataFrame) -> DataFrame:
    """(conversation_id, timestamp, id, session, cwd, path, content, original, is_create): the whole file that a message's payload wrote.

    The result of a tool tells path, content and original, itself or in its `file`;
    without path or content the first call of the tool Write in the message does.
    """
    row = messages.withColumn("v", F.try_parse_json("raw_json")).filter("v IS NOT NULL")
    v = F.col("v")
    path = F.coalesce(_not_blank(text_at(v, "toolUseResult", "filePath")), _not_blank(text_at(v, "toolUseResult", "file", "filePath")))
    content = F.coalesce(F.nullif(text_at(v, "toolUseResult", "content"), F.lit("")), text_at(v, "toolUseResult", "file", "content"))
    original = F.coalesce(F.nullif(text_at(v, "toolUseResult", "originalFile"), F.lit("")), text_at(v, "toolUseResult", "file", "originalFile"), F.lit(""))

    def call(b: Column) -> Column:
        named = (F.lower(F.trim(text_at(b, "type"))) == "tool_use") & (F.lower(F.trim(text_at(b, "name"))) == "write")
        file = F.coalesce(_not_blank(text_at(b, "input", "file_path")), _not_blank(text_at(b, "input", "filePath")))
        return F.struct(F.when(named, file).alias("path"), text_at(b, "input", "content").alias("content"))

    calls = F.filter(F.transform(F.try_variant_get(v, "$.message.content", "array<variant>"), call), lambda c: c["path"].isNotNull() & _not_blank(c["content"]).isNotNull())
    row = row.withColumns({"by_result": F.struct(path.alias("path"), content.alias("content")), "by_call": F.get(calls, F.lit(0))})
    complete = F.col("by_result.path").isNotNull() & _not_blank(F.col("by_result.content")).isNotNull()
    one = row.withColumn("w", F.when(complete, F.col("by_result")).otherwise(F.col("by_call"))).filter("w.path IS NOT NULL")
    session = F.coalesce(_not_blank(text_at(v, "sessionId")), _not_blank(F.col("conversation_id").cast("string")))
    is_create = F.coalesce(F.lower(F.trim(text_at(v, "toolUseResult", "type"))) == "create", F.lit(False))
    out = one.select("conversation_id", "timestamp", "id", session.alias("session"), F.coalesce(text_at(v, "cwd"), F.lit("")).alias("cwd"), "w.path", _unix_lines(F.col("w.content")).alias("content"), _unix_lines(original).alias("original"), is_create.alias("is_create"))
    return out.filter("session IS NOT NULL")
