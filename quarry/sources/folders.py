"""Folders as tables and streams: Python data sources that walk directories.

``spark.dataSource.register(Folders)``, then ``spark.read.format("folders")``
with a schema of ``SCHEMA``; ``readStream`` gives the entries that changed since
the last poll. Paths must be visible to all executors, as on a shared mount.

Options: ``path``; ``include_subfolders`` (true), ``hidden_files`` (false),
``exclude`` (globs, a line each), ``excluded_folders`` (paths, a line each),
``partitions`` (64), ``content`` (false: no bytes are read).

What can't be read is listed with the status ``unreadable``, a file without bytes and a folder
without what lies below it; ``deleted`` and ``take_up`` keep what the index has of it.
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.functions.paths import above, glob_regex
from quarry.operators.sync import kept_back, unreadable
from quarry.sources.formats import BY_EXTENSION, extension, most_bytes

SCHEMA = "path string, parent string, name string, mtime long, size long, is_dir boolean, data binary, status string"
TAG = "CACHEDIR.TAG"
UNREADABLE = "unreadable"
#: A change may become visible so much later than its time stamp says, so polls overlap by it; readers drop known files.
OVERLAP_NS = 2_000_000_000


@dataclass
class Rules:
    root: str
    deep: bool = True
    hidden: bool = False
    globs: list[re.Pattern] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, options: dict) -> Rules:
        yes = lambda k, d: str(options.get(k, d)).lower() == "true"
        lines = lambda k: [x for x in options.get(k, "").split("\n") if x]
        globs = [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in lines("exclude")]
        return cls(options["path"].rstrip("/") or "/", yes("include_subfolders", "true"), yes("hidden_files", "false"), globs, [f.rstrip("/") for f in lines("excluded_folders")])

    def banned(self, path: str) -> bool:
        return any(path == f or path.startswith(f + "/") for f in self.excluded)

    def skips(self, path: str, name: str) -> bool:
        return (not self.hidden and name.startswith(".")) or any(g.match(name.lower()) for g in self.globs) or self.banned(path)

    def children(self, folder: str) -> tuple[list[os.DirEntry], list[str], bool]:
        """(files, folders) of a folder, and whether it could be read; links are not followed."""
        files, folders = [], []
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return files, folders, False
        for e in entries:
            if self.skips(e.path, e.name):
                continue
            if e.is_dir(follow_symlinks=False):
                if self.deep and not os.path.exists(os.path.join(e.path, TAG)):
                    folders.append(e.path)
            elif e.is_file(follow_symlinks=False):
                files.append(e)
        return files, folders, True


@dataclass
class Subtree(InputPartition):
    """Folders of one task; those in ``flat`` without what lies below them."""

    deep: list[str]
    flat: list[str]
    since_ns: int = -1
    until_ns: int = 1 << 62


def divide(rules: Rules, partitions: int, since_ns: int = -1, until_ns: int = 1 << 62) -> list[Subtree]:
    """Subtrees for about so many tasks: the driver opens levels until there are enough folders, and no more."""
    flat, deep = [], [] if rules.banned(rules.root) else [rules.root]
    while deep and len(deep) < partitions:
        below = [f for d in deep for f in rules.children(d)[1]]
        flat += deep
        deep = below
    parts = [Subtree(deep[i::partitions], flat[i::partitions], since_ns, until_ns) for i in range(partitions)]
    return [p for p in parts if p.deep or p.flat] or [Subtree([], [])]


def bytes_of(path: str, most: int) -> tuple[bytes | None, str | None]:
    """(bytes, status) of a file."""
    try:
        with open(path, "rb") as f:
            return f.read(most), None
    except OSError:
        return None, UNREADABLE


def walk(rules: Rules, part: Subtree, content: bool) -> Iterator[tuple]:
    """Rows of the files, and of the folders, that changed in the time of the partition."""
    todo = [(f, False) for f in part.flat] + [(d, True) for d in part.deep]
    while todo:
        folder, deep = todo.pop()
        files, folders, readable = rules.children(folder)
        todo += [(f, True) for f in folders] if deep else []
        for path, is_dir in [(folder, True), *((e.path, False) for e in files)]:
            row = (path, os.path.dirname(path), os.path.basename(path))
            try:
                info = os.lstat(path)
            except FileNotFoundError:
                continue  # gone since its folder was read
            except OSError:
                yield *row, None, None, is_dir, None, UNREADABLE
                continue
            # a moved file keeps its time of change but not that of its entry
            if not part.since_ns < max(info.st_mtime_ns, info.st_ctime_ns) <= part.until_ns and (readable or not is_dir):
                continue
            data, status = None, None if readable or not is_dir else UNREADABLE
            if content and stat.S_ISREG(info.st_mode) and info.st_size <= (most := most_bytes(BY_EXTENSION.get(extension(row[2]), ""))):
                data, status = bytes_of(path, most)
            yield *row, max(int(info.st_mtime), 0), info.st_size, is_dir, data, status


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.rules, self.options = Rules.of(options), options

    def partitions(self) -> list[Subtree]:
        return divide(self.rules, int(self.options.get("partitions", "64")))

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return walk(self.rules, partition, self.options.get("content", "false") == "true")


class _StreamReader(DataSourceStreamReader):
    """Offsets are times, whatever the number of files; a deletion shows as a change of its folder."""

    def __init__(self, options: dict) -> None:
        self.rules, self.options = Rules.of(options), options

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Subtree]:
        return divide(self.rules, int(self.options.get("partitions", "64")), start["ns"] - OVERLAP_NS if start["ns"] > 0 else -1, end["ns"])

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return walk(self.rules, partition, self.options.get("content", "false") == "true")

    def commit(self, end: dict) -> None:
        """Nothing is held between polls."""


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options)


def take_up(indexed: DataFrame, changes: DataFrame, listing: DataFrame) -> DataFrame:
    """The indexed (path, mtime, size, ...) after a poll, given the listing now.

    Changed files replace theirs. Below a changed folder, files that are no
    longer listed leave, and listed ones that are not indexed enter: a moved
    folder shows as a change of its own and its parent's entry only. What can't be read
    stays as it is indexed.
    """
    columns = [c for c in indexed.columns if c in listing.columns]
    barred = unreadable(listing)
    now = listing.where("NOT is_dir AND status IS NULL").select(*columns)
    changed = changes.where("NOT is_dir AND status IS NULL").select(*columns).dropDuplicates(["path"])
    touched = changes.where("is_dir").select(F.col("path").alias("folder")).distinct()
    def below(files: DataFrame) -> DataFrame:
        return files.select("path", F.explode(above(F.col("path"))).alias("folder")).join(touched, "folder", "left_semi").select("path").distinct()

    gone = kept_back(below(indexed).join(now.select("path"), "path", "left_anti"), barred)
    entered = below(now.join(indexed.select("path"), "path", "left_anti").join(changed.select("path"), "path", "left_anti"))
    new = now.join(entered, "path", "left_semi").unionByName(changed.join(now.select("path"), "path", "left_semi"))
    kept = indexed.join(changed.select("path"), "path", "left_anti").join(gone, "path", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
