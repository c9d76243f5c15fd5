"""Commits of a git work tree: helpers around the git command, and a Spark data source over its log."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

COMMIT = "commit string, author string, at long, subject string, files array<string>"
_FIELD, _RECORD = "\x1f", "\x1e"


def run(root: str, *args: str, timeout: int = 10) -> str | None:
    """The output of a git command; None if git fails, is missing or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout, errors="replace")
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def head(root: str, short: bool = False) -> str | None:
    out = run(root, "rev-parse", *(["--short"] if short else []), "HEAD", timeout=5)
    return out.strip() if out else None


def changed_files(root: str, start: str, end: str = "HEAD") -> list[str]:
    out = run(root, "diff", "--name-only", start, end)
    return out.splitlines() if out else []


def file_at(root: str, commit: str, path: str) -> str | None:
    return run(root, "show", f"{commit}:{path}")


def log(root: str, since: str | None = None, paths: list[str] | None = None, limit: int = 50) -> list[tuple]:
    """(commit, author, at, subject, files), the newest first."""
    args = ["log", f"--max-count={limit}", f"--format={_RECORD}%H{_FIELD}%an{_FIELD}%at{_FIELD}%s", "--name-only", *([f"--since={since}"] if since else []), *(["--", *paths] if paths else [])]
    rows = []
    for record in (run(root, *args, timeout=30) or "").split(_RECORD)[1:]:
        first, *files = record.strip("\n").split("\n")
        commit, author, at, subject = first.split(_FIELD, 3)
        rows.append((commit, author, int(at), subject, [f for f in files if f]))
    return rows


def line_log(root: str, path: str, start: int, end: int, limit: int = 10) -> list[tuple]:
    """(commit, author, at, subject) of commits that touched these lines."""
    out = run(root, "log", f"-L{start},{end}:{path}", "-s", f"--max-count={limit}", f"--format=%H{_FIELD}%an{_FIELD}%at{_FIELD}%s", timeout=30)
    found = [x.split(_FIELD, 3) for x in (out or "").splitlines() if x]
    return [(commit, author, int(at), subject) for commit, author, at, subject in found]


def commits(spark: SparkSession, root: str, **options) -> DataFrame:
    return spark.createDataFrame(log(root, **options), COMMIT)


class GitLogSource(DataSource):
    """spark.read.format("gitlog").option("path", root): the log as a table, for sessions that registered this class."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return COMMIT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        yield from log(self.options["path"], self.options.get("since"), None, int(self.options.get("limit", 50)))
