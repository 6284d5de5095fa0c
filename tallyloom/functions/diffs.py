"""Unified diffs: recognising, extracting and tokenising. Small per-text helpers and the columns built on them."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import attributable, header_path, match_keys, strip_space, token_path

# Files in which the kind of quote is a matter of style.
QUOTE_STYLE_FILES = (".css", ".scss", ".sass", ".less", ".html", ".svelte", ".tsx", ".jsx", ".ts", ".js")
#: Lines of context of diffs made from an old and a new text.
CONTEXT = 3

# Keys of a payload that only an edit has.
MUTATION_KEYS = ("oldString", "newString", "replaceAll", "userModified", "structuredPatch", "oldStart", "newStart", "oldLines", "newLines")
#: The number that a tool puts before a line of a file; so many lines in a hundred must have one, of three lines at least.
NUMBER, NUMBERED_PERCENT, LEAST_LINES = r"^\s*\d+\s*(?:→|\t|\||:)\s?", 70, 3

HEADER = re.compile(r"^(diff --git |--- |\+\+\+ |Index: )")
FENCE = re.compile(r"^```(?:diff|patch|udiff)[^\n]*\n(.*?)^```", re.MULTILINE | re.DOTALL)
HEREDOC = re.compile(r"cat\s*>\s*(['\"]?)([^\s'\"<>|;]+)\1\s*<<-?\s*(['\"]?)(\w+)\3\n(.*?)^\s*\4\s*$", re.MULTILINE | re.DOTALL)
CREATED = re.compile(r"^(?:File created successfully at:|Created file|Wrote)\s+(\S+)[^\n]*\n(.*)", re.DOTALL)
NUMBERED = re.compile(r"^\s*\d+(?:→|\t)(.*)$")


def is_unified_diff(text: str) -> bool:
    """Has changed lines, and a header with a hunk or a pair of file lines, or file lines with a hunk."""
    rows = text.splitlines()
    changed = any(r[:1] in "+-" and r[:3] not in ("+++", "---") for r in rows if r)
    git, hunk = any(r.startswith("diff --git ") for r in rows), any(r.startswith("@@") for r in rows)
    files = any(r.startswith("--- ") for r in rows) and any(r.startswith("+++ ") for r in rows)
    return changed and ((git and (hunk or files)) or (files and hunk))


def edit_diff(path: str, old: str, new: str) -> str:
    """The diff that turns old into new; '' if there is no difference."""
    rows = difflib.unified_diff(old.splitlines(), new.splitlines(), f"a/{path}" if old else "/dev/null", f"b/{path}", lineterm="", n=CONTEXT)
    body = "\n".join(rows)
    return f"diff --git a/{path} b/{path}\n{body}\n" if body else ""


def structured_diff(path: str, hunks: list[dict]) -> str:
    """A diff of hunks given as first lines, counts and arrays of lines."""
    out = [f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}"]
    for h in hunks:
        rows = [str(x) for x in h.get("lines") or []]
        counts = {side: h.get(f"{side}Lines", sum(r[:1] in (" ", sign) for r in rows)) for side, sign in (("old", "-"), ("new", "+"))}
        out += [f"@@ -{h.get('oldStart', 1)},{counts['old']} +{h.get('newStart', 1)},{counts['new']} @@", *rows]
    return "\n".join(out) + "\n" if hunks else ""


def apply_patch_diffs(text: str) -> list[str]:
    """Diffs of the sections of patches between *** Begin Patch and *** End Patch."""
    out = []
    for body in re.findall(r"\*\*\* Begin Patch\n(.*?)(?:\*\*\* End Patch|\Z)", text, re.DOTALL):
        for kind, path, rest in re.findall(r"\*\*\* (Update|Add|Delete) File: ([^\n]+)\n(.*?)(?=\*\*\* (?:Update|Add|Delete) File: |\Z)", body, re.DOTALL):
            moved = re.search(r"\*\*\* Move to: ([^\n]+)\n", rest)
            target = moved[1].strip() if moved else path.strip()
            rows = [r for r in rest.splitlines() if r[:1] in ("+", "-", " ", "@") and not r.startswith("*** ")]
            if kind == "Add":
                rows = ["@@ -0,0 +1 @@", *[r for r in rows if r.startswith("+")]]
            elif rows and not rows[0].startswith("@@"):
                rows.insert(0, "@@")
            files = [f"--- {'/dev/null' if kind == 'Add' else 'a/' + path.strip()}", f"+++ {'/dev/null' if kind == 'Delete' else 'b/' + target}"]
            out.append("\n".join([f"diff --git a/{path.strip()} b/{target}", *files, *rows]) + "\n")
    return out


def heredoc_diffs(text: str) -> list[str]:
    return [edit_diff(path.lstrip("/"), "", body) for _, path, _, _, body in HEREDOC.findall(text)]


def reliable_diff(text: str | None) -> str:
    """The diff that a message's text surely holds, or '': a log of a created file, a fenced or plain diff, a patch, a heredoc."""
    text = text or ""
    if made := CREATED.match(text):
        rows = [NUMBERED.match(r) for r in made[2].splitlines()]
        body = "\n".join(m[1] for m in rows if m) if rows and all(rows) else made[2]
        return edit_diff(made[1], "", body)
    if fenced := [body for body in FENCE.findall(text) if HEADER.match(body) and is_unified_diff(body)]:
        return max(fenced, key=len)
    start = re.search(r"^(?:diff --git |--- )", text, re.MULTILINE)
    if start and is_unified_diff(text[start.start() :]):
        return text[start.start() :]
    found = apply_patch_diffs(text) or heredoc_diffs(text)
    return "".join(found)


def _string_leaves(value, cwd: str = "") -> Iterator[tuple[str, object]]:
    """(working folder, leaf or object) of JSON in the order of sorted keys; JSON within strings is read too."""
    if isinstance(value, dict):
        cwd = value.get("cwd") if isinstance(value.get("cwd"), str) else cwd
        yield cwd, value
        if value.get("type") == "tool_use" and "input" in value and "toolUseResult" in value:
            return
        for k in sorted(value):
            yield from _string_leaves(value[k], cwd)
    elif isinstance(value, list):
        for v in value:
            yield from _string_leaves(v, cwd)
    elif isinstance(value, str):
        if value[:1] in "{[" and value[-1:] in "}]":
            try:
                yield from _string_leaves(json.loads(value), cwd)
                return
            except ValueError:
                pass
        yield cwd, value


def relative_path(path: str, cwd: str) -> str:
    return path[len(cwd) + 1 :] if cwd and path.startswith(cwd.rstrip("/") + "/") else path.lstrip("/")


def written_diff(path: str, item: dict) -> str:
    """The diff of a whole file that an object shows as created or edited; '' for one that was only read (operators.payload_files has the rule as a column)."""
    rows = item["content"].splitlines()
    full = [r for r in rows if r.strip()]
    voted = sum(re.match(NUMBER, r) is not None for r in full)
    numbered = len(full) >= LEAST_LINES and 100 * voted >= NUMBERED_PERCENT * len(full)
    if not full or not (numbered or item.get("type") == "create" or any(k in item for k in MUTATION_KEYS)):
        return ""
    body = "\n".join(re.sub(NUMBER, "", r) if numbered and r.strip() else r for r in rows)
    return edit_diff(path, item.get("originalFile") or "", body)


def json_diffs(raw: str | None) -> list[str]:
    """Distinct diffs of a raw JSON payload: texts, structured patches and edits; whole files only if nothing else is found."""
    try:
        root = json.loads(raw or "null")
    except ValueError:
        return []
    found, files = [], []
    for cwd, item in _string_leaves(root):
        if isinstance(item, str):
            if diff := reliable_diff(item):
                found.append(diff)
            continue
        path = item.get("filePath") or item.get("file_path") or item.get("path")
        if not isinstance(path, str):
            continue
        path = relative_path(path, cwd)
        old, new = item.get("oldString", item.get("old_string")), item.get("newString", item.get("new_string"))
        if isinstance(item.get("structuredPatch"), list) and item["structuredPatch"]:
            found.append(structured_diff(path, item["structuredPatch"]))
        elif isinstance(old, str) and isinstance(new, str):
            found.append(edit_diff(path, old, new))
        elif isinstance(item.get("content"), str):
            files.append(written_diff(path, item))
    return list(dict.fromkeys(d for d in found or files if d))


@F.pandas_udf(T.StringType())
def reliable_diff_column(text: pd.Series) -> pd.Series:
    return text.map(reliable_diff)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_diffs_column(raw: pd.Series) -> pd.Series:
    return raw.map(json_diffs)


def style_norm(line: Column, path: Column) -> Column:
    """A line with all quotes made double, without space; '' where quotes aren't a matter of style or don't close.

    Quoted parts are read from left to right, each to the next quote of its kind; what
    is left between them must hold no quote.
    """
    quoted = r"""'([^']*)'|"([^"]*)\""""
    of_style = F.coalesce(F.regexp_like(F.lower(path), F.lit("(?:" + "|".join(re.escape(e) for e in QUOTE_STYLE_FILES) + ")$")), F.lit(False))
    open_ = F.regexp_like(F.regexp_replace(line, quoted, ""), F.lit("['\"]"))
    good = of_style & F.regexp_like(line, F.lit("['\"]")) & ~F.regexp_like(line, F.lit(r"[`\\]")) & ~open_
    return F.coalesce(F.when(good, strip_space(F.regexp_replace(line, quoted, '"$1$2"'))), F.lit(""))


def added_removed(diff: Column) -> Column:
    """struct(added, removed): changed lines of a diff without its file lines."""
    rows = F.split(diff, "\n")
    added = F.filter(rows, lambda r: r.startswith("+") & ~r.startswith("+++"))
    removed = F.filter(rows, lambda r: r.startswith("-") & ~r.startswith("---"))
    return F.struct(F.size(added).cast("long").alias("added"), F.size(removed).cast("long").alias("removed"))


def without_binary(diff: Column) -> Column:
    """A diff without the blocks of binary files."""
    blocks = F.filter(F.split(diff, r"(?m)^(?=diff --git )"), lambda b: ~F.regexp_like(b, F.lit(r"(?m)^(?:GIT binary patch|Binary files )")))
    return F.array_join(blocks, "")


def tokens(diffs: DataFrame, key: str, diff: str = "diff_content") -> DataFrame:
    """(key, position, path, sign, line, norm, keys, attributable) of each changed line that isn't blank.

    A line is a file header by its prefix before it is a change, so a removed line
    that begins with "-- " is read as a header of the old side. Added lines belong to
    the last new path, removed ones to the last old path, carried by windows within
    one diff.
    """
    rows = diffs.select(key, F.posexplode(F.split(F.regexp_replace(F.col(diff), "\r\n", "\n"), "\n")).alias("position", "row"))
    r = F.col("row")
    git, fields = r.startswith("diff --git "), F.split(F.trim(r), r"\s+")
    old = F.when(r.startswith("--- "), header_path(F.substr(r, F.lit(5)))).when(r.startswith("rename from "), header_path(F.substr(r, F.lit(13)))).when(git, header_path(F.get(fields, F.lit(2))))
    new = F.when(r.startswith("+++ "), header_path(F.substr(r, F.lit(5)))).when(r.startswith("rename to "), header_path(F.substr(r, F.lit(11)))).when(git, header_path(F.get(fields, F.lit(3))))
    w = W.partitionBy(key).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    sides = rows.withColumns({"old": F.last(old, True).over(w), "new": F.last(new, True).over(w)})
    changed = sides.withColumn("path", token_path(F.coalesce(F.when(r.startswith("+"), F.col("new")).otherwise(F.col("old")), F.lit(""))))
    changed = changed.filter((r.startswith("+") & ~r.startswith("+++")) | (r.startswith("-") & ~r.startswith("---")))
    line, sign = F.substr(r, F.lit(2)), F.substring(r, 1, 1)
    out = changed.select(key, "position", "path", sign.alias("sign"), line.alias("line"), strip_space(line).alias("norm")).filter("norm != ''")
    return out.withColumns({"keys": match_keys(F.col("path"), F.col("sign"), F.col("norm")), "attributable": attributable(F.col("norm"))})


def file_changes(diffs: DataFrame, key: str, diff: str = "diff_content") -> DataFrame:
    """(key, path, added, removed): changed lines per file."""
    return tokens(diffs, key, diff).groupBy(key, "path").agg(F.count_if(F.col("sign") == "+").alias("added"), F.count_if(F.col("sign") == "-").alias("removed"))


def renamed_files(diffs: DataFrame, key: str, diff: str = "diff_content") -> DataFrame:
    """(key, old_path, path) of files that a diff moved."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(F.col(diff), F.lit(r"(?m)^rename from (.+)$"), F.lit(1)).alias("a"), F.regexp_extract_all(F.col(diff), F.lit(r"(?m)^rename to (.+)$"), F.lit(1)).alias("b")
    )
    return diffs.select(key, F.explode(pairs).alias("p")).select(key, F.col("p.a").alias("old_path"), F.col("p.b").alias("path"))
