"""Paths: globs, hidden names, excluded folders, folders that cover a path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A whole-string, case-insensitive pattern of ``*`` and ``?`` as a regular expression."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.lower())
    return rf"(?s)\A{body}\z"


def under(path: Column, folder: str) -> Column:
    """Strictly below a folder, by whole components; a range that Parquet can skip by."""
    return path.startswith(folder.rstrip("/") + "/")


def covers(path: Column, parent: Column, folder: str, include_subfolders: bool) -> Column:
    return under(path, folder) if include_subfolders else parent == F.lit(folder.rstrip("/"))


def skips(relative: Column, *, hidden_files: bool = False, names: tuple[str, ...] = ()) -> Column:
    """Some component of a path below its root is hidden or matches a glob."""
    patterns = [glob_regex(n) for n in names]

    def component(c: Column) -> Column:
        out = F.lit(False) if hidden_files else c.startswith(".")
        for p in patterns:
            out = out | F.lower(c).rlike(p)
        return out

    return F.exists(F.split(relative, "/"), component)


def excluded(path: Column, folders: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for f in folders:
        out = out | (path == f.rstrip("/")) | under(path, f)
    return out


def above(path: Column) -> Column:
    """All folders that a path lies in."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(steps, 1, n), "/")))
