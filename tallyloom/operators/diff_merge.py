"""Merging of the diffs that one conversation made to a file, in their order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import fold_groups

HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: Added lines from which two hunks of like text (Jaccard above one half) are one.
ALIKE_LINES, ALIKE = 3, 0.5


def parse(diff: str) -> list[tuple[int, int, list[str], list[str]]]:
    """Changes (first old line, first new line, removed, added) of a diff, split at unchanged lines."""
    out, old, new, removed, added = [], 0, 0, [], []

    def close():
        nonlocal removed, added
        if removed or added:
            out.append((old - len(removed), new - len(added), removed, added))
        removed, added = [], []

    inside = False
    for row in diff.removesuffix("\n").split("\n"):
        if m := HUNK.match(row):
            close()
            old, new, inside = int(m[1]) + (m[2] == "0"), int(m[3]) + (m[4] == "0"), True
        elif row.startswith("diff --git "):
            close()
            inside = False
        elif inside and row.startswith("-"):
            removed.append(row[1:])
            old += 1
        elif inside and row.startswith("+"):
            added.append(row[1:])
            new += 1
        elif inside and not row.startswith("\\"):
            close()
            old, new = old + 1, new + 1
    close()
    return out


class _Composed:
    """A file as runs of first lines (start, count) and runs of new ones: the line map of all diffs so far.

    Later edits only cut and replace runs, so what an edit overwrites of an earlier one
    is gone, and the change against the first state is what lies between the runs of
    first lines that are left.
    """

    def __init__(self):
        self.runs: list[list] = [[1, None, None]]  # start, count (None to the end of the file), new lines
        self.first: dict[int, str] = {}  # first lines as diffs have shown them

    @staticmethod
    def _size(run: list) -> int | None:
        return run[1] if run[2] is None else len(run[2])

    def _cut(self, line: int) -> int:
        """The place among the runs before which `line` (from 1) begins, a run cut there if it must be."""
        left = line - 1
        for i, run in enumerate(self.runs):
            size = self._size(run)
            if left == 0:
                return i
            if size is None or left < size:
                if run[2] is None:
                    self.runs[i : i + 1] = [[run[0], left, None], [run[0] + left, None if size is None else size - left, None]]
                else:
                    self.runs[i : i + 1] = [[0, 0, run[2][:left]], [0, 0, run[2][left:]]]
                return i + 1
            left -= size
        return len(self.runs)

    def replace(self, line: int, removed: list[str], added: list[str]) -> None:
        end = self._cut(line + len(removed))
        before = len(self.runs)
        start = self._cut(line)
        end += len(self.runs) - before
        at = line
        for run in self.runs[start:end]:
            if run[2] is None:
                for k in range(run[1]):
                    self.first.setdefault(run[0] + k, removed[at - line + k])
            at += self._size(run)
        alone = all(run[2] is None for run in self.runs[start:end]) and all(run[2] is None or not run[2] for run in self.runs[max(0, start - 1) : start] + self.runs[end : end + 1])
        alike = next((run for run in self.runs if run[2] and _alike(run[2], added)), None) if alone else None
        if alike is not None:
            alike[2] = added
            return
        self.runs[start:end] = [[0, 0, added]]

    def changes(self) -> list[tuple[int, list[str], list[str]]]:
        """(first old line, removed, added), in order."""
        out, line, added = [], 1, []
        for run in self.runs:
            if run[2] is not None:
                added += run[2]
                continue
            if run[0] > line or added:
                out.append((line, [self.first.get(k, "") for k in range(line, run[0])], added))
            added = []
            line = run[0] + (run[1] or 0)
        return out


def merge(diffs: list[str]) -> str:
    """One diff against the first state: each diff's changes, last first, are put into the composed line map of those before it."""
    composed = _Composed()
    for diff in diffs:
        for line, _, removed, added in reversed(parse(diff)):
            composed.replace(line, removed, added)
    out, shift = [], 0
    for at, gone, came in composed.changes():
        same = 0
        while same < min(len(gone), len(came)) and gone[same] == came[same]:
            same += 1
        at, gone, came = at + same, gone[same:], came[same:]
        while gone and came and gone[-1] == came[-1]:
            gone, came = gone[:-1], came[:-1]
        if not gone and not came:
            continue
        out.append(f"@@ -{at - (not gone)},{len(gone)} +{at + shift - (not came)},{len(came)} @@")
        out += ["-" + x for x in gone] + ["+" + x for x in came]
        shift += len(came) - len(gone)
    return "\n".join(out) + "\n" if out else ""


def apply(diff: str, lines: list[str]) -> list[str]:
    """The lines after a diff whose removed lines are theirs."""
    for at, _, removed, added in reversed(parse(diff)):
        lines = [*lines[: at - 1], *added, *lines[at - 1 + len(removed) :]]
    return lines


def _alike(a: list[str], b: list[str]) -> bool:
    x, y = {s.strip() for s in a if s.strip()}, {s.strip() for s in b if s.strip()}
    return min(len(a), len(b)) >= ALIKE_LINES and len(x & y) > ALIKE * len(x | y)


def sections(diffs: DataFrame, diff: str = "content") -> DataFrame:
    """One row per file section of each diff, with its `file`."""
    each = diffs.withColumn("section", F.explode(F.filter(F.split(diff, r"(?m)^(?=diff --git )"), lambda s: s != "")))
    return each.withColumn("file", F.regexp_extract("section", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1))


def merge_by_file(diffs: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(key, file, merged, n): all diffs of a conversation to a file as one, in order of (timestamp, id)."""

    def fold(at: tuple, group: list[tuple]) -> list[tuple]:
        return [(str(at[0]), at[1], merge([section for (section,) in group]), len(group))]

    return fold_groups(sections(diffs), [key, "file"], ["timestamp", "id"], ["section"], fold, f"{key} string, file string, merged string, n long")
