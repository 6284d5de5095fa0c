import json

from tallyloom import schemas
from tallyloom.functions import payloads


def message(i, t, role, content, raw, kind="", model=""):
    return (i, t, "p", "c", role, kind, model, content, json.dumps(raw) if raw else "")


def test_models():
    assert payloads.find_model({"a": [{"modelName": " "}, {"b": {"model_slug": "m"}}]}) == "m"
    assert payloads.find_model([1, "x"]) == ""


def test_classification(spark):
    ask = {"message": {"content": [{"type": "tool_use", "name": "AskUserQuestion", "input": {"questions": [{"header": "H", "question": "Q?", "options": [{"label": "A", "description": "a"}, {"label": "B"}]}]}}]}}
    answer = {"toolUseResult": {"questions": ask["message"]["content"][0]["input"]["questions"], "answers": {"Q?": "A, mine"}}}
    rows = [message("1", 1, "agent", "", ask), message("2", 2, "user", "", answer), message("3", 3, "agent", "done", {"message": {"stop_reason": "end_turn"}}), message("4", 4, "user", "do", None), message("5", 5, "user", "/clear", None)]
    got = {r.id: r for r in payloads.classified(spark.createDataFrame(rows, schemas.MESSAGES)).collect()}
    assert [got[str(i)].message_type for i in range(1, 6)] == ["question", "answer", "final_answer", "prompt", "log"]
    assert got["1"].content == "### H\nQ?\n\nOptions:\n- **A**: a\n- **B**"
    assert got["2"].content == "### H\nQuestion: Q?\n\n- [x] **A**: a\n- [ ] **B**\n\nCustom:\n- mine"


def test_parents_and_models(spark):
    session = "01234567-89ab-cdef-0123-456789abcdef"
    rows = [message("1", 1, "user", "<system-reminder>x", None), message("2", 2, "user", f"see /x/{session}.jsonl", None, model="b"), message("3", 3, "agent", "x", None, model="a"), message("4", 4, "agent", "x", None, model="b")]
    frame = spark.createDataFrame(rows, schemas.MESSAGES)
    assert [tuple(r) for r in payloads.parents_from_prompts(frame).collect()] == [("c", session)]
    assert payloads.models_seen(frame).first().models == ["b", "a"]


def test_derived_diffs_take_free_times(spark):
    edit = {"toolUseResult": {"filePath": "a.py", "oldString": "x\n", "newString": "y\n"}}
    rows = [message("1", 10, "agent", "e", edit), message("2", 11, "agent", "f", None), message("3", 12, "agent", "again", edit)]
    got = sorted((r.timestamp, r.id, r.message_type) for r in payloads.with_derived_diffs(spark.createDataFrame(rows, schemas.MESSAGES)).collect())
    assert [g[1] for g in got if g[2] == "diff"] == ["1-diff-0"] and len({g[0] for g in got}) == 4


def test_snapshots(spark):
    rows = [("c", 1, "1", "a.txt", "", "one\n", True), ("c", 2, "2", "a.txt", "", "two\n", False), ("c", 3, "3", "b.txt", "", "lost\n", False)]
    frame = spark.createDataFrame(rows, "conversation_id string, timestamp long, id string, path string, original string, content string, is_create boolean")
    got = [r.diff for r in payloads.snapshot_diffs(frame).orderBy("timestamp").collect()]
    assert len(got) == 2 and "+one" in got[0] and "-one\n+two" in got[1]
