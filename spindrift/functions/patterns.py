"""Path patterns: ignore files and globs, each compiled to one regular expression that Spark evaluates."""

from __future__ import annotations

import re
from fnmatch import translate

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are never scanned.
ALWAYS_SKIP = [
    "__pycache__", ".git", ".hg", ".svn",
    "node_modules", ".venv", "venv", "env",
    "build", "dist", ".eggs", ".mypy_cache", ".pytest_cache",
    ".tox", ".nox",
]


def ignore_regex(pattern: str) -> str:
    """A gitignore pattern (without its leading !) as a regular expression over relative paths."""
    folder_only, body = pattern.endswith("/"), pattern.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1 + (body[i + 1 : i + 2] == "*")
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder_only else '(?:/.*)?'}$"


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Later patterns override earlier ones; ! brings paths back.  Blank lines and comments do not count."""
    out = F.lit(False)
    for raw in patterns:
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        bring_back = line.startswith("!")
        out = F.when(path.rlike(ignore_regex(line[1:] if bring_back else line)), F.lit(not bring_back)).otherwise(out)
    return out


def in_skipped_folder(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda x: x.isin(ALWAYS_SKIP) | x.endswith(".egg-info"))


def glob_regex(pattern: str) -> str:
    """A glob in which * crosses folders, anchored at both ends, in Java's syntax."""
    return re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"(?s)^(?:\1)$", translate(pattern).replace("(?>", "(?:"))


def in_layer(path: Column, pattern: str) -> Column:
    """A layer's pattern matches a path as a glob, or as a prefix once its stars and slashes at the end are gone."""
    return path.rlike(glob_regex(pattern)) | path.startswith(pattern.rstrip("*").rstrip("/"))
