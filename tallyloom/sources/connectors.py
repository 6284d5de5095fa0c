"""Sources that Spark has no reader for: a git log, a SQLite key-value table, growing JSONL files."""

from __future__ import annotations

import glob
import json
import os
import sqlite3
import subprocess
import time as clock
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql import functions as F

# The fields of a log record and the options of diffs, and the table of key-value stores.
LOG_FORMAT = "%H%x1f%an%x1f%ae%x1f%ct%x1f%s%x1e"
DIFF_OPTIONS = ("--unified=0", "-M", "-w", "--ignore-blank-lines")
KEY_VALUE_TABLE = "cursorDiskKV"
#: The commit that stands for what isn't committed.
WORKING_COPY = "working-copy"


class _Repository(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GitLogReader(DataSourceReader):
    """One partition for each repository (option `path`, separated by newlines); with `workingCopy` a last row for its uncommitted changes."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split("\n") if p]
        self.revision, self.diffs, self.most = options.get("revision", "HEAD"), options.get("diffs", "false") == "true", options.get("most")
        self.working_copy = options.get("workingCopy", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_Repository(p) for p in self.paths]

    def read(self, partition: _Repository) -> Iterator[tuple]:
        def git(*args: str) -> str:
            return subprocess.run(["git", "-C", partition.path, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")

        log = git("log", "--reverse", f"--format={LOG_FORMAT}", *([f"--max-count={self.most}"] if self.most else []), self.revision)
        for record in log.split("\x1e"):
            if record.strip():
                commit, name, email, time, subject = record.strip("\n").split("\x1f")
                diff = git("show", "--format=", *DIFF_OPTIONS, commit) if self.diffs else ""
                yield partition.path, commit, name, email, int(time), subject, diff
        if self.working_copy:
            diff = git("diff", *DIFF_OPTIONS, "HEAD")
            if diff:
                name, email = (git("config", "--default", "", "--get", key).strip() for key in ("user.name", "user.email"))
                yield partition.path, WORKING_COPY, name, email, int(clock.time()), "Working copy", diff


class GitLogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "repository string, commit_hash string, user_name string, user_email string, authored_at long, subject string, diff_content string"

    def reader(self, schema) -> DataSourceReader:
        return GitLogReader(self.options)


class _Keys(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class KeyValueReader(DataSourceReader):
    """Rows of a SQLite table of keys and values, in ranges of row numbers."""

    def __init__(self, options: dict):
        self.path, self.table, self.prefix = options["path"], options.get("table", KEY_VALUE_TABLE), options.get("prefix", "")
        self.parts = int(options.get("partitions", "4"))

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Keys(self.path, a, a + step) for a in range(low, high + 1, step)] or [_Keys(self.path, 0, 0)]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        with self._open() as db:
            for key, value in db.execute(f'SELECT key, value FROM "{self.table}" WHERE rowid >= ? AND rowid < ? AND key >= ?', (partition.first, partition.last, self.prefix)):
                if key.startswith(self.prefix):
                    yield key, value.decode("utf-8", "replace") if isinstance(value, bytes) else value


class KeyValueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return KeyValueReader(self.options)


class TailReader(SimpleDataSourceStreamReader):
    """Whole lines appended to the files of a glob since the last batch; a file that shrank is read anew.

    For the machine that writes the files: offsets are bytes by file, up to the last line end.
    """

    def __init__(self, options: dict):
        self.pattern = options["path"]

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _lines(self, start: dict, end: dict | None) -> tuple[list[tuple], dict]:
        before, after, rows = json.loads(start["files"]), {}, []
        limits = json.loads(end["files"]) if end else None
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            size, at = os.path.getsize(path), before.get(path, 0)
            at = 0 if size < at else at
            with open(path, "rb") as file:
                file.seek(at)
                data = file.read((limits.get(path, at) if limits is not None else size) - at)
            whole = data[: data.rfind(b"\n") + 1]
            after[path] = at + len(whole)
            rows += [(path, line) for line in whole.decode("utf-8", "replace").splitlines()]
        return rows, {"files": json.dumps(after)}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._lines(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start, end)[0])


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "source_file string, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return TailReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (GitLogSource, KeyValueSource, TailSource):
        spark.dataSource.register(source)


def commit_range(membership: DataFrame, base: str, head: str) -> DataFrame:
    """Commits of branch head that branch base hasn't; membership: (branch_name, commit_hash)."""
    ours = membership.filter(F.col("branch_name") == head)
    return ours.join(membership.filter(F.col("branch_name") == base).select("commit_hash"), "commit_hash", "left_anti")
