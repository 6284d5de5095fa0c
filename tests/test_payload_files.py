"""Files in payloads, rule by rule."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import payload_files as files


def add(path, *lines):
    return f"diff --git a/{path} b/{path}\n--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n" + "\n".join("+" + x for x in lines)


CASES = [
    # a file that was only read isn't written, whatever its shape
    ({"type": "text", "path": "notes.txt", "content": "just read this file"}, []),
    ({"filePath": "a.py", "content": "x\ny\nz", "numLines": 3, "totalLines": 3}, []),
    # a key of an edit, even without value, makes it a change
    ({"filePath": "./a.py", "content": "x\r\ny\n", "userModified": None}, [("a.py", add("a.py", "x", "y"))]),
    ({"filePath": "a.py", "content": " \n", "newString": ""}, []),
    ({"filePath": "a.py", "content": 5, "text": "z", "newString": ""}, [("a.py", add("a.py", "z"))]),
    # numbered lines: three at least, 70 in a hundred
    ({"path": "b.txt", "content": "  1→one\n  2→two\n\n  3→three"}, [("b.txt", add("b.txt", "one", "two", "", "three"))]),
    ({"path": "b.txt", "content": "1\tone\n2\ttwo"}, []),
    ({"path": "b.txt", "content": "\n".join(f"{i}: l" for i in range(7)) + "\nx\ny\nz"}, [("b.txt", add("b.txt", *["l"] * 7, "x", "y", "z"))]),
    ({"path": "b.txt", "content": "\n".join(f"{i}: l" for i in range(6)) + "\nx\ny\nz"}, []),
    # paths below the repository, the folder, or whole
    ({"cwd": "/home/me/repo/sub", "r": {"filePath": "/home/me/repo/sub/a.py", "content": "x", "oldLines": 1}}, [("sub/a.py", add("sub/a.py", "x"))]),
    ({"cwd": "/else", "r": [{"filePath": "/home/me/repo/b.py", "content": "x", "oldLines": 1}]}, [("b.py", add("b.py", "x"))]),
    ({"cwd": "/tmp/x/", "filePath": "/tmp/x/y/c.py", "content": "x", "oldLines": 1}, [("y/c.py", add("y/c.py", "x"))]),
    ({"filePath": "/tmp/d.py", "content": "x", "oldLines": 1}, [("tmp/d.py", add("tmp/d.py", "x"))]),
    # calls of tools are left out with what they hold
    ({"message": {"content": [{"type": "tool_use", "input": {"path": "e.py", "content": "x", "newString": ""}}]}}, []),
    # a patch goes before whole files
    ({"filePath": "f.py", "content": "whole", "structuredPatch": [{"oldStart": 3, "oldLines": 1, "newStart": 3, "newLines": 1, "lines": ["-x", "+y", "z", ""]}, {"lines": []}]},
     [("f.py", "diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -3,1 +3,1 @@\n-x\n+y\n z")]),
    ({"filePath": "f.py", "structuredPatch": [{"lines": [" same"]}]}, []),
    ([{"path": "g.py", "content": "x", "oldLines": 1}, {"path": "g.py", "content": "x", "oldLines": 1}], [("g.py", add("g.py", "x"))]),
    ("no object", []), (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    payloads = spark.createDataFrame([(i, json.dumps(c, ensure_ascii=False)) for i, (c, _) in enumerate(CASES)] + [(90, None), (91, "{broken"), (92, "")], "id int, raw_json string")
    roots = spark.createDataFrame([("/home/me/repo",), ("/home/me",), ("/home/me/repo/",)], "root string")
    return files.file_diffs(payloads, "id", roots=roots).collect()


def test_every_rule(found):
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.place)):
        got.setdefault(r.id, []).append((r.path, r.diff))
    assert got == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_files_of_one_folder_are_not_dealt_by_it(spark):
    rows = spark.range(200).selectExpr("id", """'{"cwd": "/r", "filePath": "/r/s/a.py", "content": "x", "newString": "' || id || '"}' AS raw_json""")
    found = files.file_diffs(rows, "id", roots=spark.createDataFrame([("/r",)], "root string"))
    assert {(r.path, r.diff) for r in found.collect()} == {("s/a.py", add("s/a.py", "x"))} and found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(folder" not in plan and "hashpartitioning(cwd" not in plan
    assert plan[: plan.find("Initial Plan")].count("Exchange hashpartitioning(id") <= 1


def test_the_largest_diff_goes(spark):
    rows = [(1, [0], "a", "xx"), (1, [1], "b", "xxx"), (1, [2], "c", "yyy"), (2, [0, 5], "d", ""), (2, [0, 4], "e", "")]
    frame = spark.createDataFrame(rows, "id int, place array<int>, path string, diff string")
    assert sorted((r.id, r.path) for r in files.largest_diff(frame, "id").collect()) == [(1, "b"), (2, "e")]


def test_written_files(spark):
    cases = [
        ({"toolUseResult": {"type": " Create", "filePath": "a", "content": "x\r\ny", "originalFile": None}, "sessionId": "s"}, ("s", "a", "x\ny", "", True)),
        ({"toolUseResult": {"filePath": "", "file": {"filePath": "b", "content": "n", "originalFile": "o"}}}, ("7", "b", "n", "o", False)),
        ({"toolUseResult": {"filePath": "c", "content": " "}, "message": {"content": [{"type": "text"}, {"type": "TOOL_USE", "name": "write", "input": {"filePath": "d", "content": ""}}, {"type": "tool_use", "name": "Write", "input": {"file_path": "e", "content": "w"}}]}}, ("7", "e", "w", "", False)),
        ({"message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": "e", "content": "w"}}]}}, None), ({"message": {"content": "text"}}, None), ({}, None),
    ]
    frame = spark.createDataFrame([(7, i, f"m{i}", json.dumps(c)) for i, (c, _) in enumerate(cases)], "conversation_id long, timestamp long, id string, raw_json string")
    got = {r.timestamp: (r.session, r.path, r.content, r.original, r.is_create) for r in files.written_files(frame).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases) if want}
    assert files.written_files(frame.withColumn("raw_json", F.lit(None).cast("string"))).count() == 0
