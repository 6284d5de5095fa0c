"""Worked vectors for the operators, in tables of a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.functions import diffs, text
from tallyloom.operators import attribution, commits, conversations, diff_merge, messages, mutations, projects, search, search_index
from tallyloom.plans import api
from tallyloom.sinks import export
from tallyloom.sources import connectors, transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def ms(spark, stamp):
    return spark.sql(f"SELECT unix_millis(TIMESTAMP'{stamp}')").first()[0]


@pytest.mark.parametrize(
    "pattern, path, hit",
    [("*.map", "a/b/x.map", True), ("*.map", "a/map", False), ("**/node_modules/**", "node_modules/x/y.js", True), ("**/node_modules/**", "a/node_modules/x.js", True), ("src/*.py", "src/a/b.py", False),
     ("src/**/b.py", "src/b.py", True), ("go.sum", "deep/go.sum", True), ("docs", "docs/a.md", True), ("[ab]?.txt", "x/a1.txt", True), ("[!ab]?.txt", "a1.txt", False)],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, text.ignored_path(F.lit(path), pattern, defaults=False)) is hit


def test_text_functions(spark):
    assert one(spark, text.strip_space(F.lit(" a b\tc "))) == "abc"
    assert one(spark, text.path_aliases(F.lit("a/b/c/d/e"))) == ["a/b/c/d/e", "b/c/d/e", "c/d/e"]
    assert one(spark, text.header_path(F.lit("b/x y\t2020"))) == "x"
    assert one(spark, text.header_path(F.lit("/dev/null"))) == ""
    assert one(spark, text.token_path(F.lit(".\\src\\a.c"))) == "src/a.c"
    assert one(spark, text.extension_key(F.lit("src/Main.GO"))) == ".go"
    assert one(spark, text.extension_key(F.lit("src/Makefile"))) == "Makefile"
    for remote in ("git@github.com:Own/Repo.git", "https://github.com/own/repo", "ssh://git@github.com:22/own/repo.git"):
        assert one(spark, text.repo_key(F.lit(remote))) == "github.com/own/repo"
    assert one(spark, text.commit_url(F.lit("https://gitlab.com/g/s/r.git"), F.lit("abc"))) == "https://gitlab.com/g/s/r/-/commit/abc"
    assert one(spark, text.rating_command(F.lit("/bb 4 good work"))).asDict() == {"rating": 4, "note": "good work"}
    assert one(spark, text.rating_command(F.lit("[$bb](skill.md) 5"))).asDict() == {"rating": 5, "note": ""}
    assert one(spark, text.rating_command(F.lit("/bb 9"))) is None
    assert one(spark, text.is_rating_command(F.lit("/bbq"))) is False
    assert one(spark, text.title(F.lit("<tag> " + "x" * 1200))) == "x" * 1000 + "..."
    assert one(spark, text.summary_title(F.lit("**Done**"))) == "Done"
    assert one(spark, text.common_folder(F.array(*map(F.lit, ("/a/b/c", "/a/b/d/e", "/a/b"))))) == "/a/b"
    assert one(spark, text.epoch_ms(F.lit("1700000000"))) == one(spark, text.epoch_ms(F.lit(1700000000000))) == one(spark, text.epoch_ms(F.lit("2023-11-14T22:13:20Z"))) == 1700000000000
    assert one(spark, text.epoch_ms(F.lit("soon"))) is None
    assert one(spark, text.line_jaccard(F.lit("a\nb"), F.lit("b\n c "))) == pytest.approx(1 / 3)
    assert one(spark, text.percent_label(F.lit(99.6))) == "99.6%" and one(spark, text.percent_label(F.lit(50.4))) == "50%"
    assert one(spark, text.duration(F.lit(3_725_000))) == "1h 2m"


def test_ratings_by_agent(spark):
    convs = spark.createDataFrame([("1", "c", False), ("2", "c", False), ("3", "c", False), ("4", "x", False), ("5", "x", False)], "id string, agent string, hidden boolean")
    ratings = spark.createDataFrame([("1", 5), ("2", 3), ("4", 4)], "conversation_id string, rating int")
    histogram = conversations.ratings_by_agent(convs, ratings)
    assert rows(histogram) == [("c", 0, 1), ("c", 3, 1), ("c", 5, 1), ("x", 0, 1), ("x", 4, 1)]
    assert rows(conversations.rating_totals(histogram)) == [("c", 3, 2, 4.0), ("x", 2, 1, 4.0)]


def test_daily_activity_counts_a_conversation_once_on_its_last_day(spark):
    messages_ = spark.createDataFrame(
        [("1", ms(spark, "2026-03-10 09:00:00"), "main", "user", "prompt"), ("2", ms(spark, "2026-03-11 08:00:00"), "main", "user", "answer"), ("3", ms(spark, "2026-03-10 10:00:00"), "hidden", "user", "prompt"),
         ("4", ms(spark, "2026-03-11 09:00:00"), "child", "user", "prompt"), ("5", ms(spark, "2026-03-11 10:00:00"), "child", "user", "prompt")],
        "id string, timestamp long, conversation_id string, role string, message_type string",
    )
    convs = spark.createDataFrame([("main", "", "main", False), ("hidden", "", "hidden", True), ("child", "main", "main", False)], "id string, parent_conversation_id string, family_root_id string, hidden boolean")
    out = conversations.daily_activity(messages_, convs, "2026-03-10", "2026-03-13", zone="UTC")
    assert [(str(r.day), r.conversations, r.prompts, r.answers) for r in out.orderBy("day").collect()] == [("2026-03-10", 0, 1, 0), ("2026-03-11", 2, 1, 1), ("2026-03-12", 0, 0, 0)]


def test_local_days_follow_summer_time(spark):
    stamp = ms(spark, "2026-03-08 07:30:00")  # 23:30 on the 7th in Los Angeles, the night clocks change
    assert str(one(spark, text.local_date(F.lit(stamp), "America/Los_Angeles"))) == "2026-03-07"
    assert str(one(spark, text.local_date(F.lit(stamp), None, 480))) == "2026-03-07"


def test_repeats_are_measured_from_the_last_kept(spark):
    data = [(str(i), t, "c", "user", "prompt", "m", "x") for i, t in enumerate((0, 6000, 12_000, 40_000, 49_999, 50_000))]
    frame = spark.createDataFrame(data + [("z", 6000, "c", "user", "prompt", "other", "x")], "id string, timestamp long, conversation_id string, role string, message_type string, model string, content string")
    assert [r.id for r in messages.suppress_repeats(frame).orderBy("timestamp", "id").collect()] == ["0", "z", "2", "3", "5"]


def test_insert_messages(spark):
    def frame(*data):
        full = [(i, t, "p", "c", role, kind, "", content, "") for i, t, role, kind, content in data]
        return spark.createDataFrame(full, schemas.MESSAGES)

    stored = frame(("1", 0, "user", "prompt", "hello"))
    new = frame(("2", 5000, "user", "", "hello"), ("3", 60_000, "user", "", "hello"), ("4", 1, "agent", "prompt", "as agent"), ("5", 2, "user", "", "[hidden]"), ("6", 3, "user", "", "/bb 5"), ("7", 4, "agent", "", "[event_msg:token_count] 5"))
    out = {r.id: r.message_type for r in messages.insert_messages(stored, new).collect()}
    assert out == {"1": "prompt", "3": "prompt", "4": "log", "6": "log"}


def test_interpolation_and_unique_times(spark):
    frame = spark.createDataFrame([("c", 1, None), ("c", 2, 100), ("c", 3, None), ("c", 4, 103), ("c", 5, 103), ("c", 6, None)], "c string, i int, timestamp long")
    assert [r.timestamp for r in messages.interpolate_times(frame, "c", "i").orderBy("i").collect()] == [99, 100, 101, 103, 104, 105]


def test_families_and_pages(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)] + [(50, 49)], "id long, parent_conversation_id long")
    assert {r.id: r.family_root_id for r in conversations.family_roots(chain).collect()} == {**dict.fromkeys(range(20), 0), 50: 50}
    convs = spark.createDataFrame([(1, 1, 1, 10, 100, False), (2, 1, 1, 20, 300, False), (3, 1, 3, 5, 200, False), (4, 1, 4, 5, 999, True)], "id long, project_id long, family_root_id long, started_at long, ended_at long, hidden boolean")
    out = conversations.family_page(convs, 1, 1, spark.createDataFrame([(2,)], "id long")).collect()
    assert [(r.id, r.shown_at) for r in out] == [(1, 300), (2, 300)]


def test_nearest_rating(spark):
    ratings = spark.createDataFrame([("a", 4, "fine ", 100_000), ("b", 4, "fine", 500_000), ("c", 3, "fine", 100_000)], "id string, rating int, note string, created_at long")
    history = spark.createDataFrame([("x", 4, "fine", 40_000), ("y", 4, "fine", 159_999), ("z", 4, "fine", 39_999)], "conversation_id string, rating int, note string, timestamp long")
    assert rows(conversations.reconcile_nearest(ratings, history)) == [("a", "y", 59_999)]


def test_rating_commands_are_used_once(spark):
    ratings = spark.createDataFrame([("r1", "c", 1000, 1), ("r2", "c", 2000, 2)], "id string, conversation_id string, created_at long, seq long")
    commands = spark.createDataFrame([("m1", "c", 1900), ("m2", "c", 100)], "id string, conversation_id string, timestamp long")
    assert rows(conversations.match_rating_commands(ratings, commands)) == [("r1", "m2"), ("r2", "m1")]


def test_largest_remainder(spark):
    frame = spark.createDataFrame([("k", "a", 33.4), ("k", "b", 33.3), ("k", "c", 33.3)], "k string, agent string, exact double")
    assert rows(commits.largest_remainder(frame, ["k"], "agent", "exact").select("agent", "units")) == [("a", 34), ("b", 33), ("c", 33)]


def test_effective_coverage(spark):
    data = spark.createDataFrame([("1", 10, 4, '{"a": 25, "b": 50}'), ("2", 10, 4, None), ("3", 10, 4, "{}")], "id string, lines_total long, lines_from_agent long, override_agent_percents string")
    measured = spark.createDataFrame([("2", "a", 4)], schemas.COVERAGE)
    assert rows(commits.effective_coverage(data, measured)) == [("1", "a", 3), ("1", "b", 5), ("2", "a", 4), ("3", "unknown", 4)]


def test_file_type_coverage(spark):
    files = [("1", "src/main.go", 100, 60), ("1", "src/utils.go", 50, 30), ("1", "README.md", 20, 10), ("1", "Makefile", 15, 5), ("2", "src/main.go", 80, 60), ("2", "src/handler.go", 60, 45)]
    frame = spark.createDataFrame([(*f, False) for f in files] + [("2", "vendor/lib.go", 9, 0, True)], "commit_id string, path string, lines long, agent_lines long, ignored boolean")
    out = {r.extension: (r.n_files, r.lines, r.agent_lines) for r in commits.file_type_coverage(frame).collect()}
    assert out == {".go": (3, 290, 195), ".md": (1, 20, 10), "Makefile": (1, 15, 5)}


def test_search_modes(spark):
    frame = spark.createDataFrame([(1, "Fix the BIG bug"), (2, "big fix"), (3, None)], "id long, content string")
    ids = lambda term, mode: [r.id for r in frame.filter(search.contains([F.col("content")], term, mode)).collect()]
    assert ids("big fix", "phrase") == [2] and ids("big fix", "all_tokens") == [1, 2] and ids("ix", "all_tokens") == [1, 2] and ids(" ", "phrase") == []
    assert ("big", 1) in rows(search.trigram_index(frame, "id", "content").select("trigram", "id"))


def tokens(spark, diff, owner="commit_id", **more):
    frame = diffs.tokens(spark.createDataFrame([(k, d) for k, d in diff.items()], f"{owner} string, diff_content string"), owner)
    frame = frame.withColumn("style", diffs.style_norm(F.col("line"), F.col("path")))
    for name, values in more.items():
        frame = frame.withColumn(name, F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(owner)])
    return frame


def diff_of(path, *added, removed=()):
    return "\n".join([f"diff --git a/{path} b/{path}", f"--- a/{path}", f"+++ b/{path}", "@@ -1 +1 @@", *["-" + x for x in removed], *["+" + x for x in added]])


def test_tokeniser(spark):
    out = tokens(spark, {"c": diff_of("src/a.js", "x = 'y';", "}", "", removed=["old", "-- sql"])})
    assert [(r.path, r.sign, r.norm, r.attributable, r.style) for r in out.orderBy("position").collect()] == [("src/a.js", "-", "old", True, ""), ("src/a.js", "+", "x='y';", True, 'x="y";'), ("src/a.js", "+", "}", False, "")]


def attributed(spark, commit, written, authored=10_000):
    commits_ = spark.createDataFrame([("c", authored)], "id string, authored_at long")
    theirs = tokens(spark, {k: d for k, (d, _, _) in written.items()}, "message_id", timestamp={k: t for k, (_, t, _) in written.items()}, agent={k: a for k, (_, _, a) in written.items()})
    theirs = theirs.withColumn("conversation_id", F.concat(F.lit("conv-"), "message_id"))
    return commits_, tokens(spark, {"c": commit}), theirs


def test_newer_message_wins(spark):
    d = diff_of("a.txt", "shared line")
    out = attribution.match_lines(*attributed(spark, d, {"m-old": (d, 9_999_000, "x"), "m-new": (d, 10_000_000, "y"), "m-late": (d, 10_300_001, "z")}))
    assert [(r.message_id, r.agent) for r in out.collect()] == [("m-new", "y")]


def test_formatting_and_quotes(spark):
    commit = diff_of("src/app.js", "const result = foo(bar, baz);", 'let s = "q";') + "\n" + diff_of("src/reflow.js", "return alpha +", "beta + gamma;")
    message = diff_of("src/app.js", "const result = foo(", "bar, baz);", "let s = 'q';") + "\n" + diff_of("src/reflow.js", "return alpha + beta + gamma;")
    out = attribution.match_lines(*attributed(spark, commit, {"m": (message, 10_000_000, "x")}))
    assert sorted((r.path, r["pass"]) for r in out.collect()) == [("src/app.js", "formatting"), ("src/app.js", "style"), ("src/reflow.js", "formatting"), ("src/reflow.js", "formatting")]


def test_fallback_needs_enough_lines(spark):
    names = ["alpha", "beta", "gamma", "delta", "epsilon"]
    tables = attributed(spark, diff_of("small.txt", *names), {"m": (diff_of("elsewhere/deep/other.txt", *names), 10_000_000, "x")})
    assert [(r.path, r.agent, r.lines, r.percent) for r in attribution.attribute(*tables).collect()] == [("small.txt", "x", 5, 100.0)]
    tables = attributed(spark, diff_of("small.txt", "alpha"), {"m": (diff_of("elsewhere/deep/other.txt", *names), 10_000_000, "x")})
    assert attribution.attribute(*tables).count() == 0


def test_fallback_files_give_back_what_they_took(spark):
    names = [f"line number {i} of it" for i in range(12)]
    commit = diff_of("a.txt", *names[:5], *[f"own {i}" for i in range(10)]) + "\n" + diff_of("b.txt", *names)
    tables = attributed(spark, commit, {"m": (diff_of("elsewhere/deep/other.txt", *names), 10_000_000, "x")})
    assert rows(attribution.attribute(*tables).select("path", "agent", "lines")) == [("b.txt", "x", 12)]
    # ignored files take nothing, and lines that another pass has used aren't served again
    commits_, mine, theirs = tables
    none = spark.createDataFrame([], "commit_id string, position int, path string, message_id string, conversation_id string, agent string, used array<int>")
    files = spark.createDataFrame([("c", "a.txt", False, False, 15), ("c", "b.txt", True, False, 12)], "commit_id string, path string, ignored boolean, moved boolean, lines_total long")
    assert attribution.fallback_lines(commits_, mine, none, theirs, files).count() == 0
    used = spark.createDataFrame([("c", -1, "z", "m", "conv-m", "x", sorted(r.position for r in theirs.collect())[:3])], none.schema)
    assert attribution.fallback_lines(commits_, mine, used, theirs).count() == 0


def test_meta_and_rating_texts_are_logs(spark):
    frame = spark.createDataFrame(
        [("a", 1, "c", "user", "", "", "do it", "{}"), ("b", 2, "c", "user", "", "", "do that", '{"isMeta":true}'), ("d", 3, "c", "user", "", "", "Base directory for this skill: /x\nThe user wants to rate this conversation.", "{}"), ("e", 4, "c", "user", "", "", "/bb 4", "{}")],
        "id string, timestamp long, conversation_id string, role string, message_type string, model string, content string, raw_json string",
    )
    out = messages.insert_messages(frame.limit(0), frame)
    assert rows(out.select("id", "message_type")) == [("a", "prompt"), ("b", "log"), ("d", "log"), ("e", "log")]


def test_files_edited_reads_headers_of_any_message(spark):
    frame = spark.createDataFrame(
        [("c", 2, "m2", "log", "x\ndiff --git a/b.py b/b.py\n+1\ndiff --git a/gone.py b/gone.py\ndeleted file"), ("c", 1, "m1", "diff", "diff --git a/b.py b/b.py\ndiff --git a/(.+?) b/x\n"), ("d", 1, "m3", "diff", "+++ b/no.py"), ("e", 1, "m4", "log", "diff --git a/" + "p" * 2000 + " b/q")],
        "conversation_id string, timestamp long, id string, message_type string, content string",
    )
    assert rows(conversations.files_edited(frame)) == [("c", "b.py\ngone.py"), ("e", "p" * 1024)]


def test_deleted_files_follow_the_commit(spark):
    d = diff_of("a.txt", "one line")
    tables = attributed(spark, d + "\n" + diff_of("gone.txt", removed=["bye now", "and you"]), {"m": (d, 10_000_000, "x")})
    assert rows(attribution.attribute(*tables).select("path", "agent", "lines")) == [("a.txt", "x", 1), ("gone.txt", "x", 2)]
    assert {k: f.count() for k, f in api.recompute_coverage(*tables).items()} == {"files": 2, "links": 1, "lines": 1, "commits": 1}


def test_mutations(spark):
    old = spark.createDataFrame([("1", "p", "h1", 5, 1), ("2", "p", "h2", 6, 1)], "id string, project_id string, commit_hash string, authored_at long, lines_total long")
    new = spark.createDataFrame([("9", "p", "h2", 7, 8), ("3", "p", "h3", 9, 9)], old.schema)
    assert rows(mutations.upsert_commits(old, new)) == [("1", "p", "h1", 5, 1), ("2", "p", "h2", 6, 8), ("3", "p", "h3", 9, 9)]
    assert rows(mutations.insert_or_ignore(old, new, ["commit_hash"]).select("id")) == [("1",), ("2",), ("3",)]
    parents = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, parent_conversation_id string")
    convs = spark.createDataFrame([("a", ""), ("b", "kept"), ("c", "")], parents.schema)
    assert rows(mutations.set_parent(convs, parents)) == [("a", "x"), ("b", "kept"), ("c", "")]


def test_path_resolution(spark):
    projs = spark.createDataFrame([("p1", "/w/one", "/old/one\n", "", "", "git@h.org:o/one.git"), ("p2", "/w/two", "", "", "https://h.org/o/two-alt", "https://h.org/o/two")], "id string, path string, old_paths string, git_worktree_paths string, alt_remotes string, remote string")
    asked = spark.createDataFrame([("a", "/old/one/sub", ""), ("b", "/w/two", ""), ("c", "/w/two/deep/er", ""), ("d", "/x", "https://h.org/o/two-alt.git"), ("e", "/y/one", "")], "request string, path string, remote string")
    assert rows(projects.resolve_paths(asked, projs)) == [("a", "p1", 0), ("b", "p2", 1), ("c", "p2", 2), ("d", "p2", 3)]
    assert dict(rows(projects.resolve_imports(asked, projs, "none")))["e"] == "p1"


def test_diff_extraction():
    d = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    assert diffs.reliable_diff("text\n```diff\n" + d + "```\n") == d
    assert diffs.reliable_diff("only\n- a list\n+ of things") == ""
    assert "+++ b/new.py" in diffs.reliable_diff("*** Begin Patch\n*** Add File: new.py\n+print(1)\n*** End Patch")
    assert "+hi" in diffs.reliable_diff("cat > notes.txt <<'EOF'\nhi\nEOF\n")
    raw = json.dumps({"cwd": "/w", "toolUseResult": {"filePath": "/w/a.py", "oldString": "x\n", "newString": "y\n", "structuredPatch": [{"oldStart": 1, "newStart": 1, "lines": ["-x", "+y"]}]}})
    assert diffs.json_diffs(raw) == ["diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,1 +1,1 @@\n-x\n+y\n"]


def test_quote_style(spark):
    cases = [("a = 'it", "x.js", ""), ("a = 'b'", "x.py", ""), ("a = 'b'", "X.TSX", 'a="b"'), ("""x = 'say "hi"' + "it's"; """, "a/b.css", """x="say"hi""+"it's";"""), ("`a` 'b'", "x.ts", ""), ("no quotes", "x.ts", ""), (r"a = 'b\'c'", "x.js", ""), (None, "x.js", ""), ("'a'", None, ""), ("'a' \"b' c", "x.js", "")]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, line string, path string, want string")
    assert [r[0] for r in frame.orderBy("id").select(diffs.style_norm(F.col("line"), F.col("path"))).collect()] == [c[2] for c in cases]


def test_lines_in_several_files_take_sources_in_turn(spark):
    # the same line stands in three files of a commit; two files share a path suffix with the message's
    message = diff_of("w/src/lib/a.js", "same line here", "same line here") + "\n" + diff_of("x/src/lib/a.js", "same line here")
    commit = diff_of("x/src/lib/a.js", "same line here", "same line here") + "\n" + diff_of("y/src/lib/a.js", "same line here", "same line here") + "\n" + diff_of("other.js", "same line here")
    out = attribution.match_lines(*attributed(spark, commit, {"m": (message, 10_000_000, "x")}))
    # the first takes the line of its own path, the second and third the two of the suffix
    assert sorted((r.position, r.path, r.used) for r in out.collect()) == [(4, "x/src/lib/a.js", [10]), (5, "x/src/lib/a.js", [4]), (10, "y/src/lib/a.js", [5])]


def test_runs_of_lines_are_used_once(spark):
    commit = diff_of("a.js", "one two", "three", "one two", "three", "four five six", "seven")
    message = diff_of("a.js", "one", "two three", "four", "five six seven")
    out = attribution.match_lines(*attributed(spark, commit, {"m": (message, 10_000_000, "x")}))
    assert sorted((r.position, r["pass"], r.used) for r in out.collect()) == [(4, "formatting", [4, 5]), (5, "formatting", []), (8, "formatting", [6, 7]), (9, "formatting", [])]


def test_sequential_diffs_merge():
    first = "@@ -1,2 +1,3 @@\n a\n-b\n+B\n+C\n"
    second = "@@ -2,1 +2,1 @@\n-B\n+BB\n"
    assert diff_merge.merge([first, second]) == "@@ -2,1 +2,2 @@\n-b\n+BB\n+C\n"
    assert diff_merge.merge([first, "@@ -2,2 +2,1 @@\n-B\n-C\n+b\n"]) == ""


@pytest.mark.parametrize("seed", range(40))
def test_merged_diffs_lead_where_the_diffs_lead(seed):
    import difflib
    import random

    rng = random.Random(seed)
    lines = [f"l{i}" for i in range(rng.randint(0, 30))]
    first, diffs_, count = list(lines), [], 0
    for _ in range(rng.randint(1, 6)):
        after = list(lines)
        for _ in range(rng.randint(1, 4)):
            at, n = rng.randint(0, len(after)), rng.randint(0, 3)
            count += 1
            after[at : at + n] = [f"n{count}.{k}" for k in range(rng.randint(0, 2))]
        diff = "\n".join(difflib.unified_diff(lines, after, "a", "b", lineterm="", n=rng.choice((0, 1, 3))))
        if diff:
            diffs_.append(diff + "\n")
        lines = after
    merged = diff_merge.merge(diffs_)
    assert diff_merge.apply(merged, first) == lines
    # and no line is both taken out and put back in place
    assert merged == diff_merge.merge([merged])


def test_alike_hunks_are_one():
    first = "@@ -0,0 +1,3 @@\n+alpha\n+beta\n+gamma\n"
    assert diff_merge.merge([first, "@@ -20,0 +24,4 @@\n+alpha\n+beta\n+gamma\n+delta\n"]) == "@@ -0,0 +1,4 @@\n+alpha\n+beta\n+gamma\n+delta\n"


def test_search_index_reads_its_terms_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "insert", "prompt", "Fix the big bug"), (2, "insert", "prompt", "a bigger fix"), (3, "insert", "log", "big bug"), (4, "insert", "prompt", None), (5, "insert", "prompt", "ÄÖÜ bug")], "id long, op string, message_type string, content string")
    search_index.apply_batch(str(tmp_path), 1, rows)
    find = lambda term, mode="phrase", now=rows: sorted(r.id for r in search_index.search(str(tmp_path), now, term, mode).collect())
    assert find("BIG") == [1, 2] and find("big fix") == [] and find("fix big", "all_tokens") == [1, 2] and find("äöü b") == [5] and find("ü") == [5] and find(" ") == []
    found = search_index.candidates(spark, str(tmp_path), ["bug"])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    changes = spark.createDataFrame([(1, "update", "prompt", "nothing"), (2, "delete", "prompt", ""), (3, "update", "prompt", "big bug")], rows.schema)
    search_index.apply_batch(str(tmp_path), 2, changes)
    now = changes.filter("op != 'delete'").unionByName(rows.filter("id > 3"))
    assert find("big", now=now) == [3] and [r.id for r in search_index.candidates(spark, str(tmp_path), ["big"]).collect()] == [3]
    into = search_index.compact(spark, str(tmp_path), str(tmp_path / "again"))
    assert [r.id for r in search_index.candidates(spark, into, ["big"]).collect()] == [3] and search_index.candidates(spark, into, ["fix"]).count() == 0


def test_sources(spark, tmp_path):
    line = {"type": "assistant", "sessionId": "s", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "assistant", "model": "m", "content": [{"type": "text", "text": "hello"}, {"type": "text", "text": "hello"}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(line) + "\n" + json.dumps({"type": "user", "sessionId": "s"}) + "\n")
    out = transcripts.session_lines(transcripts.read_lines(spark, str(tmp_path))).collect()
    assert [(r.session_id, r.role, r.content, r.timestamp) for r in out] == [("s", "agent", "hello", 1767225600000)]
    lines = [{"timestamp": 1, "type": "session_meta", "payload": {"id": "t", "cwd": "/w"}}, {"timestamp": 2, "type": "turn_context", "payload": {"model": "m2"}}, {"timestamp": 3, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "do it"}]}}]
    frame = spark.createDataFrame([(json.dumps(x), "/x/rollout-1-t.jsonl", i) for i, x in enumerate(lines)], "value string, source_file string, line int")
    assert [(r.session_id, r.cwd, r.model, r.role, r.content) for r in transcripts.rollouts(frame).collect()] == [("t", "/w", "m2", "user", "do it")]
    document = {"sessionId": "s", "model": "m", "directories": ["/w"], "messages": [{"timestamp": "2026-01-01T00:00:00Z", "type": "user", "content": "hi"}]}
    assert [(r.cwd, r.content) for r in transcripts.session_documents(spark.createDataFrame([(json.dumps(document), "f")], "value string, source_file string")).collect()] == [("/w", "hi")]


def test_connectors(spark, tmp_path):
    import sqlite3
    import subprocess

    connectors.register(spark)
    with sqlite3.connect(tmp_path / "kv.db") as db:
        db.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
        db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", ("composerData:c1", json.dumps({"composerId": "c1", "fullConversationHeadersOnly": [{"bubbleId": "b1", "type": 1}]})))
        db.execute("INSERT INTO cursorDiskKV VALUES (?, ?)", ("bubbleId:c1:b1", json.dumps({"text": "hi"})))
    entries = spark.read.format("sqlite_kv").load(str(tmp_path / "kv.db"))
    assert [(r.composerId, r.text) for r in transcripts.composers(entries).collect()] == [("c1", "hi")]
    repo = tmp_path / "repo"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=U", "-c", "user.email=u@x.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "f.txt").write_text("one\n")
    run("add", "."), run("commit", "-qm", "first")
    out = spark.read.format("git_log").option("diffs", "true").load(str(repo)).collect()
    assert [(r.user_name, r.subject, "+one" in r.diff_content) for r in out] == [("U", "first", True)]


def test_tail_reader(tmp_path):
    file = tmp_path / "log.jsonl"
    file.write_text("a\nb\nhalf")
    reader = connectors.TailReader({"path": str(tmp_path / "*.jsonl")})
    got, offset = reader.read(reader.initialOffset())
    assert [x[1] for x in got] == ["a", "b"]
    with file.open("a") as out:
        out.write("way\n")
    got, offset = reader.read(offset)
    assert [x[1] for x in got] == ["halfway"]
    file.write_text("new\n")
    assert [x[1] for x in reader.read(offset)[0]] == ["new"]


def test_stream_ingestion_is_repeatable(spark, tmp_path):
    from tallyloom.streaming import ingest

    data = [("1", 0, "p", "c", "user", "", "", "hello", ""), ("2", 5000, "p", "c", "user", "", "", "hello", ""), ("3", 60_000, "p", "c", "user", "", "", "hello", "")]
    spark.createDataFrame(data, schemas.MESSAGES).write.parquet(str(tmp_path / "in"))
    stored = str(tmp_path / "stored")
    for attempt in ("one", "two"):
        stream = spark.readStream.schema(schemas.MESSAGES).parquet(str(tmp_path / "in"))
        ingest.ingest_messages(stream, stored, str(tmp_path / attempt)).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{stored}/messages").collect()) == ["1", "3"]
        assert [(r.id, r.started_at, r.ended_at, r.user_prompt_count) for r in spark.read.parquet(f"{stored}/conversations").collect()] == [("c", 0, 60_000, 2)]


def test_markdown_export(spark):
    commits_ = spark.createDataFrame([("c", "abcdef1234", "Fix", 5)], "id string, commit_hash string, subject string, authored_at long")
    out = export.markdown(commits_, spark.createDataFrame([("c", "v")], schemas.LINKS), spark.createDataFrame([("v", 1, "please\nfix")], "conversation_id string, timestamp long, content string"))
    assert out.first()["section"] == "## Fix (`abcdef12`)\n\n> please\n> fix"


def test_tokens_keep_lines_of_any_length(spark):
    long = "x" * 1_200_000
    frame = spark.createDataFrame([("k", f"--- a/m.js\n+++ b/m.js\n@@ -1 +1 @@\n-{long}a\n+{long}b\n")], "id string, diff_content string")
    got = {r.sign: r.line for r in diffs.tokens(frame, "id").collect()}
    assert got == {"-": f"{long}a", "+": f"{long}b"}


def test_a_search_looks_at_more_commits_than_a_page_may_have(spark):
    frame = spark.range(1500).selectExpr("id", "'main' AS branch_name", "concat('h', id) AS commit_hash", "IF(id % 100 = 0, 'Urgent', 'x') AS subject", "'a@b.c' AS user_email", "id AS authored_at")
    for emails in (["A@b.c"], spark.createDataFrame([(" A@b.c",), ("a@b.c",)], "user_email string")):
        out = api.found_commits(frame, "main", "urgent", size=5, number=3, emails=emails)
        assert [r.id for r in out["page"].collect()] == [400, 300, 200, 100, 0] and out["count"].first()["n_commits"] == 15


def test_pairs_go_with_the_lines_of_commits_not_with_how_often_a_text_was_written(spark, monkeypatch):
    keys = text.match_keys(F.col("path"), F.col("sign"), F.col("norm"))
    line = {"position": F.lit(0), "path": F.lit("src/a.js"), "sign": F.lit("+"), "norm": F.lit("x=1"), "style": F.lit("")}
    mine = spark.range(40).select(F.col("id").cast("string").alias("commit_id"), F.lit(True).alias("attributable")).withColumns(line).withColumn("keys", keys)
    theirs = spark.range(300).select(F.format_string("m%04d", "id").alias("message_id"), F.lit("c").alias("conversation_id"), F.lit("a").alias("agent"), (F.col("id") * 1_000_000).alias("timestamp")).withColumns(line).withColumn("keys", keys)
    commits_ = spark.range(40).selectExpr("string(id) AS id", "id * 5000 + 10000 AS authored_at")
    seen, real = [], attribution._matches
    monkeypatch.setattr(attribution, "_matches", lambda *given: seen.append(given[-2].count()) or real(*given))
    out = attribution.match_lines(commits_, mine, theirs)
    # within five minutes after a commit no further message comes, so it takes that of its own time
    assert sorted((int(r.commit_id), int(r.message_id[1:])) for r in out.collect()) == [(c, c * 5 + 10) for c in range(40)]
    assert seen[0] <= 3 * 40


def test_supply_is_read_off_running_counts(spark, monkeypatch):
    week, rng = attribution.LOOK_BACK, __import__("random").Random(3)
    said = [(f"m{i}", rng.choice("xy"), rng.choice("pq"), rng.choice("cd"), rng.choice("ab"), rng.choice([week * rng.randrange(1, 4) + rng.choice([-1, 0, 1, 300_000, 300_001]), rng.randrange(4 * week)])) for i in range(300)]
    asked = [(str(c), norm, rng.choice([week * rng.randrange(1, 4), rng.randrange(4 * week) // 1000 * 1000])) for c in range(12) for norm in "xyz"]
    theirs = spark.createDataFrame(said, "message_id string, norm string, path string, conversation_id string, agent string, timestamp long")
    times = {c: at for c, _, at in asked}
    wanted = spark.createDataFrame([(c, norm) for c, norm, _ in asked], "commit_id string, norm string")
    commits_ = spark.createDataFrame([(c, at // 1000) for c, at in times.items()], "id string, authored_at long")
    monkeypatch.setattr(attribution, "in_window", lambda *_: pytest.fail("lines are met one by one"))
    got = {(r.commit_id, r.norm, r.path, r.conversation_id): (r.agent, r.n) for r in attribution.norm_supply(commits_, wanted, theirs, wanted.select("commit_id")).collect()}
    want = {}
    for c, norm, _ in asked:
        for _, text_, path, conversation, agent, at in said:
            if text_ == norm and times[c] // 1000 * 1000 - week < at <= times[c] // 1000 * 1000 + 300_000:
                known, n = want.get((c, norm, path, conversation), (agent, 0))
                want[c, norm, path, conversation] = (min(known, agent), n + 1)
    assert got == want and len(want) > 20


def test_formatting_runs_are_settled_many_files_to_a_batch(spark):
    """One file's runs took a frame of their own; files share batches now, each settled by itself."""
    n = 40
    commit = "\n".join(diff_of(f"src/f{i}.js", f"return alpha{i} +", f"beta{i};", f"call{i}(one, two);") for i in range(n))
    message = "\n".join(diff_of(f"src/f{i}.js", f"return alpha{i} + beta{i};", f"call{i}(one,", "two);") for i in range(n))
    commits_, mine, theirs = attributed(spark, commit, {"m": (message, 10_000_000, "x")})
    none = spark.createDataFrame([], "commit_id string, position int, message_id string, used array<int>")
    out = attribution.formatting_matches(commits_, mine, theirs, none)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.path, []).append(len(r.used))
    assert {path: sorted(used) for path, used in got.items()} == {f"src/f{i}.js": [0, 0, 3] for i in range(n)}  # the longest run goes first


def test_groups_are_folded_across_batches(spark):
    from pyspark.sql import functions as F

    from tallyloom.operators.groups import fold_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows_ = spark.range(1000).select((F.col("id") % 30).alias("k"), "id").repartition(5)
        out = fold_groups(rows_, ["k"], [F.desc("id")], ["id"], lambda key, found: [(key[0], [r[0] for r in found])] if key[0] else [], "k long, ids array<long>")
        assert sorted((r.k, r.ids) for r in out.collect()) == [(k, [i for i in range(999, -1, -1) if i % 30 == k]) for k in range(1, 30)]
        assert fold_groups(rows_.limit(0), ["k"], [], ["id"], lambda key, found: [key], "k long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_passes_settle_many_commits_to_a_batch(spark):
    """The fallback makes no pandas frame for each commit, and texts of several files are settled from plain rows."""
    names = ["alpha one", "beta two", "gamma three"]
    tables = attributed(spark, diff_of("b/two.txt", *names), {"m": (diff_of("far/other.txt", *names), 10_000_000, "y")})
    none = spark.createDataFrame([], "commit_id string, position int, path string, message_id string, conversation_id string, agent string, used array<int>")
    plan = attribution.fallback_lines(tables[0], tables[1], none, tables[2])._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroupsInPandas" not in plan
    # b's first line takes what a's line would have liked best
    pairs = [("a", [5, 9], "m1", 0), ("a", [5, 9], "m2", 0), ("b", [2], "m1", 0), ("b", [2], "m2", 0)]
    assert attribution._take_in_turn(pairs) == [("b", 2, ("m1", 0)), ("a", 5, ("m2", 0))]


def shuffled_bytes(spark, run):
    """What run() gives, and the bytes that its stages wrote for shuffles."""
    sc, gateway = spark.sparkContext, spark.sparkContext._gateway
    none, doubles = gateway.jvm.java.util.ArrayList(), gateway.new_array(gateway.jvm.double, 0)

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, doubles, none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    out = run()
    return out, sum(n for stage, n in written().items() if stage not in before)


def test_nested_export_sends_messages_once_for_each_set_of_conversations(spark):
    said = spark.range(400).selectExpr("id", "id % 2 AS conversation_id", "1000 - id AS timestamp", "'prompt' AS message_type", "concat_ws('', transform(sequence(1, 4), k -> sha2(concat(id, ' ', k), 256))) AS content")
    talks = spark.createDataFrame([(0, "t0", 5), (1, "t1", 3), (2, "t2", 4)], "id long, title string, started_at long")
    links = spark.range(600).selectExpr("id AS commit_id", "explode(CASE id % 3 WHEN 0 THEN array(0L, 1L, 2L) WHEN 1 THEN array(1L, 1L, 9L) ELSE array(8L) END) AS conversation_id")
    rows, sent = shuffled_bytes(spark, lambda: export.nested_export(links, talks, said).selectExpr("commit_id", "transform(conversations, c -> (c.conversation_id AS id, size(c.messages) AS n, get(c.messages, 0).id AS first)) AS c").collect())
    got = {r.commit_id: [tuple(x) for x in r.c] for r in rows}
    assert got == {i: [(1, 200, 399), (2, 0, None), (0, 200, 398)] if i % 3 == 0 else [(1, 200, 399)] * 2 for i in range(600) if i % 3 < 2}
    assert sent < 3_000_000  # one link alone has 50 kB


def test_git_roots_deal_paths_without_grouping_them(spark):
    paths = spark.createDataFrame([("/r/a/b/c",), ("/r/a/b/c",), ("/r/a",), ("/r/t/x",), ("/other",), ("/q/z",), (None,)], "path string")
    roots = spark.createDataFrame([("/r", ""), ("/r/a/b", None), ("/r/t", "/r/a/b"), ("/q/z", "")], "root string, parent string")
    found = projects.git_roots(paths, roots)
    assert rows(found) == [("/q/z", "/q/z", "z"), ("/r/a", "/r", "r"), ("/r/a/b/c", "/r/a/b", "b"), ("/r/t/x", "/r/a/b", "b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "keys=[path" not in plan and "Generate" not in plan  # neither a sort nor a hash table of opened paths in the tasks of the scan


def test_diffs_of_many_files_are_merged_without_a_frame_for_each(spark):
    hunks = [(2, 2, "@@ -1,1 +1,2 @@\n-a\n+b\n+c\n"), (1, 1, "@@ -1,1 +1,1 @@\n-z\n+a\n"), (2, 3, "@@ -2,1 +2,1 @@\n-c\n+C\n")]
    made = spark.createDataFrame([(t, i, c) for t, i, c in hunks], "timestamp long, id long, hunk string").crossJoin(spark.range(300).select(F.col("id").alias("n")))
    head = F.concat(F.lit("diff --git a/f"), "n", F.lit(" b/f"), "n", F.lit("\n--- a/f"), "n", F.lit("\n+++ b/f"), "n", F.lit("\n"))
    merged = diff_merge.merge_by_file(made.select((F.col("n") % 7).alias("conversation_id"), "timestamp", "id", F.concat(head, "hunk").alias("content")))
    assert sorted(map(tuple, merged.collect())) == sorted((str(n % 7), f"f{n}", "@@ -1,1 +1,2 @@\n-z\n+b\n+C\n", 3) for n in range(300))
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().executedPlan().toString()


def test_a_task_of_the_index_writes_one_list_of_a_gram(spark, tmp_path):
    texts = spark.range(300).coalesce(1).selectExpr("id", "'insert' AS op", "'prompt' AS message_type", "concat('Abc abc \U0001f600x', id, CASE WHEN id = 7 THEN NULL ELSE '' END) AS content")
    search_index.apply_batch(str(tmp_path), 1, texts)
    lists = {r.gram: r.ids for r in spark.read.parquet(f"{tmp_path}/postings").collect()}
    assert spark.read.parquet(f"{tmp_path}/postings").filter("gram = 'abc'").count() == 1
    assert lists["abc"] == [i for i in range(300) if i != 7] and lists[" \U0001f600x"] == lists["abc"] and lists["x25"] == [25, *range(250, 260)]
    search_index.apply_batch(str(tmp_path), 2, texts.filter("id < 10").withColumn("op", F.lit("delete")))
    into = search_index.compact(spark, str(tmp_path), str(tmp_path / "again"))
    assert sorted(i for r in spark.read.parquet(f"{into}/postings").filter("gram = 'abc'").collect() for i in r.ids) == list(range(10, 300))


def test_ingestion_writes_a_partition_as_one_file(spark, tmp_path):
    from tallyloom.streaming import ingest

    data = [(str(i), i * 60_000, "p", "c", "user", "", "m" if i % 2 else "", f"hello {i}", "") for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # rows come from as many tasks as they may
    try:
        ingest.ingest_batch(spark.createDataFrame(data, schemas.MESSAGES).repartition(8), str(tmp_path))
        named = [(str(100 + i), i * 60_000, "p", "c", "user", "", "later", "[note]", "") for i in range(0, 40, 2)]
        for batch in (named, data):  # names rewrite the partition; a batch that is run again adds nothing
            ingest.ingest_batch(spark.createDataFrame(batch, schemas.MESSAGES).repartition(8), str(tmp_path))
            assert len(list((tmp_path / "messages").rglob("*.parquet"))) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.model, r["count"]) for r in spark.read.parquet(str(tmp_path / "messages")).groupBy("model").count().collect()) == [("later", 20), ("m", 20)]
    assert [(r.started_at, r.ended_at, r.user_prompt_count) for r in spark.read.parquet(str(tmp_path / "conversations")).collect()] == [(0, 39 * 60_000, 40)]


def test_repeats_of_one_id_and_time_are_told_apart_by_their_key(spark, monkeypatch):
    from tallyloom.operators import messages as messages_

    rows_ = [("1", 0, "a"), ("2", 5000, "a"), ("2", 5000, "b"), ("3", 10_000, "a"), ("4", 15_000, "a"), ("5", 40_000, "a"), ("6", None, "a")]
    frame = spark.createDataFrame([(i, t, "c", "user", "prompt", None, x) for i, t, x in rows_], "id string, timestamp long, conversation_id string, role string, message_type string, model string, content string")
    for most in (500_000, 1):
        monkeypatch.setattr(messages_, "BROADCAST_REPEATS", most)
        kept = sorted((r.id, r.content) for r in messages_.suppress_repeats(frame).collect())
        assert kept == [("1", "a"), ("2", "b"), ("3", "a"), ("5", "a"), ("6", "a")]


def test_fallback_gives_a_commit_no_more_than_its_lines_can_take(spark):
    n_conversations, n_paths, n_commits = 60, 12, 40
    said = [(f"m{c}-{p}", 0, f"d{p}/e/f/g.txt", f"line {k}", f"c{c}", f"a{c % 3}", 1_000 + c) for c in range(n_conversations) for p in range(n_paths) for k in range(12)]
    theirs = spark.createDataFrame(said, "message_id string, position int, path string, norm string, conversation_id string, agent string, timestamp long")
    mine = spark.createDataFrame([(f"k{i}", k, "own/x.txt", f"line {k}", True) for i in range(n_commits) for k in range(12)], "commit_id string, position int, path string, norm string, attributable boolean")
    commits_ = spark.createDataFrame([(f"k{i}", 10 + i) for i in range(n_commits)], "id string, authored_at long")
    none = spark.createDataFrame([], "commit_id string, position int, path string, message_id string, conversation_id string, agent string, used array<int>")
    got, sent = shuffled_bytes(spark, lambda: attribution.fallback_lines(commits_, mine, none, theirs).collect())
    assert sorted(map(tuple, got)) == sorted((f"k{i}", "own/x.txt", "c0", "a0", 12) for i in range(n_commits))
    assert sent < 800_000  # a row for each commit, text, path and conversation made 15 MB


def test_fallback_equals_a_plain_fold_over_the_whole_supply(spark):
    from collections import Counter

    rng, window = __import__("random").Random(5), attribution.WINDOW
    folders = ["a/b/c/x.js", "q/b/c/x.js", "c/x.js", "other/f.js"]
    texts = [f"t{k}" for k in range(6)]
    said = [(f"m{i}", j, rng.choice(folders), rng.choice(texts), f"c{i % 5}", f"a{rng.randrange(3)}", rng.choice([window, 2 * window]) + rng.randrange(-window, window)) for i in range(40) for j in range(6)]
    times = {f"k{c}": window // 1000 + rng.randrange(window // 500) for c in range(25)}
    mine = [(c, i, rng.choice(folders), rng.choice(texts)) for c in times for i in range(rng.randrange(4, 45))]
    used, matched = set(), []
    for c, i, path, text_ in mine:
        sources = [s for s in said if s[3] == text_ and times[c] * 1000 - attribution.LOOK_BACK < s[6] <= times[c] * 1000 + attribution.LOOK_AHEAD and (c, s[0], s[1]) not in used]
        if sources and rng.random() < 0.3:
            s = rng.choice(sources)
            used.add((c, s[0], s[1]))
            matched.append((c, i, path, s[0], s[4], s[5], [s[1]]))
    taken, want = {m[:2] for m in matched}, []
    for c, at in times.items():
        supply = Counter()
        agents, held = {}, {}
        for s in said:
            if at * 1000 - attribution.LOOK_BACK < s[6] <= at * 1000 + attribution.LOOK_AHEAD:
                supply[s[3], s[2], s[4]] += 1 - ((c, s[0], s[1]) in used)
                held[s[3], s[2], s[4]] = min(s[5], held.get((s[3], s[2], s[4]), s[5]))
        own = [m for m in mine if m[0] == c]
        for (text_, path, talk), n in supply.items():
            if n > 0 and any(m[3] == text_ and m[:2] not in taken for m in own):
                agents[talk] = min(agents.get(talk, "z"), held[text_, path, talk])
        left, tables = Counter(), {}
        for (text_, path, talk), n in supply.items():
            left[text_] += n
            for alias in (None, *text.aliases_of(path)):
                tables.setdefault((alias, text_), Counter())[talk] += n
        for path in sorted({m[2] for m in own}):
            lines = [m[3] for m in own if m[2] == path and m[:2] not in taken]
            counts = Counter(m[4] for m in matched if m[0] == c and m[2] == path)
            main = min(counts, key=lambda k: (-counts[k], k), default=None)
            least = attribution.fallback_minimum(len([m for m in own if m[2] == path]), len(lines))
            found, undo = Counter(), []
            for text_ in lines:
                if left[text_] > 0:
                    options = [t for alias in (*text.aliases_of(path), None) if (t := tables.get((alias, text_)))]
                    t = next((t for t in options if t[main] > 0), None)
                    talk = main if t else None
                    if t is None:
                        t = next(t for t in options if max(t.values()) > 0)
                        talk = min((k for k in t if t[k] > 0), key=lambda k: (-t[k], k))
                    both = [t] if t is tables[None, text_] or tables[None, text_][talk] <= 0 else [t, tables[None, text_]]
                    for x in both:
                        x[talk] -= 1
                    left[text_] -= 1
                    found[talk] += 1
                    undo.append((text_, talk, both))
            if len(undo) >= least and len(lines) >= least:
                want += [(c, path, talk, agents[talk], n) for talk, n in found.items()]
            else:
                for text_, talk, both in undo:
                    left[text_] += 1
                    for x in both:
                        x[talk] += 1
    schema = "position int, path string, message_id string, conversation_id string, agent string, used array<int>"
    tables = [spark.createDataFrame(*x) for x in (
        (list(times.items()), "id string, authored_at long"), ([(*m, True) for m in mine], "commit_id string, position int, path string, norm string, attributable boolean"),
        (matched, f"commit_id string, {schema}"), ([s for s in said], "message_id string, position int, path string, norm string, conversation_id string, agent string, timestamp long"),
    )]
    assert sorted(map(tuple, attribution.fallback_lines(*tables).collect())) == sorted(want) and len(want) > 20


def lines_of(spark, n_owners, owner, line, path="concat('src/', id, '/main.js')"):
    """Tokens of owners with twelve lines each, of an expression over id and k."""
    rows_ = spark.range(n_owners).selectExpr("id", "explode(sequence(0, 11)) AS k").selectExpr(f"concat('{owner}', id) AS {owner}", "id", "int(k) AS position", f"{path} AS path", "'+' AS sign", f"{line} AS line")
    rows_ = rows_.withColumns({"norm": text.strip_space(F.col("line")), "style": diffs.style_norm(F.col("line"), F.col("path")), "attributable": F.lit(True), "agent": F.lit("a"), "conversation_id": F.concat(F.lit("c"), F.col("id") % 3), "timestamp": F.col("id") * 1000})
    return rows_.withColumn("keys", text.match_keys(F.col("path"), F.col("sign"), F.col("norm")))


def test_tokens_are_made_once_for_all_passes(spark):
    """Each pass read the tokens again, with all that makes their texts."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(norm):
        made.add(1)
        return norm

    word = "concat(id, ' line ', k, ' says ')"
    mine = lines_of(spark, 20, "commit_id", f"CASE k % 3 WHEN 0 THEN {word} WHEN 1 THEN concat({word}, '\"x\"') ELSE concat('own ', id, k) END").withColumn("norm", counted("norm"))
    theirs = lines_of(spark, 20, "message_id", f"CASE k % 3 WHEN 0 THEN {word} WHEN 1 THEN concat({word}, '''x''') ELSE concat('their ', id, k) END").withColumn("norm", counted("norm"))
    commits_ = spark.range(20).selectExpr("concat('commit_id', id) AS id", "id AS authored_at")
    got = attribution.match_lines(commits_, mine, theirs).groupBy("pass").count().collect()
    assert {r["pass"]: r["count"] for r in got} == {"exact": 80, "style": 80}
    assert made.value <= 2 * 20 * 12


def test_runs_meet_without_their_texts(spark):
    long = "concat_ws('', transform(sequence(1, 60), j -> sha2(concat(id, ' ', k, ' ', j), 256)))"
    mine = lines_of(spark, 10, "commit_id", f"CASE k % 2 WHEN 0 THEN {long} ELSE concat('half ', id, k) END")
    theirs = lines_of(spark, 10, "message_id", f"CASE k % 2 WHEN 0 THEN concat({long}, 'half', id, k + 1) ELSE concat('else ', id, k) END")
    commits_ = spark.range(10).selectExpr("concat('commit_id', id) AS id", "id AS authored_at")
    found, sent = shuffled_bytes(spark, lambda: attribution.match_lines(commits_, mine, theirs).select("commit_id", "position", "message_id", "used", "pass").collect())
    assert sorted(map(tuple, found)) == sorted((f"commit_id{i}", k, f"message_id{i}", [k - k % 2] if k % 2 == 0 else [], "formatting") for i in range(10) for k in range(12))
    assert sent < 200_000  # a side has half a megabyte of text


def test_hashes_of_lines_join_to_that_of_their_run(spark):
    import pyarrow as pa

    from tallyloom.functions import runs

    rng = __import__("random").Random(2)
    texts = ["", None, "é" * 9, "\x00", "\x00\x00", "x" * 300_000, *["".join(rng.choices("ab\x00é\U0001f600", k=rng.randrange(400))) for _ in range(2000)]]
    single = runs.hashes(pa.array(texts)).to_pylist()
    assert runs.hashes(pa.array(texts)[3:7]).to_pylist() == single[3:7] and runs.hashes(pa.array([], pa.string())).to_pylist() == []
    for r, t in zip(single, texts, strict=True):
        data = (t or "").encode()
        assert r["n"] == len(data)
        for f, (prime, base) in enumerate(runs.FIELDS, 1):
            assert r[f"w{f}"] == pow(base, len(data), prime)
            if len(data) < 1000:
                assert r[f"h{f}"] == sum(c * pow(base, i, prime) for i, c in enumerate(data)) % prime
    pairs = spark.createDataFrame([(a, b) for a, b in zip(texts[2:], texts[3:], strict=False)], "a string, b string")
    both = runs.joined(runs.text_run(F.col("a")), runs.text_run(F.col("b")))
    assert pairs.select(both.alias("r"), runs.text_run(F.concat("a", "b")).alias("want")).filter("NOT r <=> want").count() == 0
    assert len({(r["h1"], r["h2"], r["n"]) for r in single[2:]}) == len(set(texts[2:]))


def test_attribution_of_common_lines_sends_a_row_for_each_line(spark):
    """Each key of a line went once for either kind of path, with its text, and each conversation that had it to every commit."""
    mine = lines_of(spark, 150, "commit_id", "concat('line ', k)", "'src/own/a/file.js'")
    theirs = lines_of(spark, 150, "message_id", "concat('line ', k)", "'src/theirs/a/file.js'")
    commits_ = spark.range(150).selectExpr("concat('commit_id', id) AS id", "id AS authored_at")
    found, sent = shuffled_bytes(spark, lambda: attribution.attribute(commits_, mine, theirs).collect())
    assert sorted(map(tuple, found)) == sorted((f"commit_id{i}", "src/own/a/file.js", "a", 12, 100.0) for i in range(150))
    assert sent < 700_000
