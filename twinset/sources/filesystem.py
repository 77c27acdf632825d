"""A file tree as a catalog: a Python data source that walks below its top entries in tasks of their own.

The tree must be seen by the executors: local mode, or a shared mount. Symbolic links are rows, not followed, except
those that `follow` names; their targets then stand in their place, unless a hop lies within a boundary, loops or is
broken.
"""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.digest import file_digests
from .catalog import COLUMNS, SCHEMA

_KINDS = {stat.S_IFREG: "file", stat.S_IFDIR: "dir", stat.S_IFLNK: "symlink", stat.S_IFBLK: "blk", stat.S_IFCHR: "chr", stat.S_IFIFO: "fifo", stat.S_IFSOCK: "sock"}


def resolve_symlink(path: str, boundaries: list[str]) -> str | None:
    """The end of a chain of links, normalised; None if it is broken or loops or any hop lies within a boundary."""
    seen: set[str] = set()
    inside = lambda p: any(p == b or p.startswith(b.rstrip("/") + "/") for b in boundaries)
    while os.path.islink(path):
        if path in seen:
            return None
        seen.add(path)
        path = os.path.normpath(os.path.join(os.path.dirname(path), os.readlink(path)))
        if inside(path):
            return None
    return path if os.path.exists(path) else None


def row_of(path: str, at: str, root: str) -> tuple | None:
    try:
        s = os.lstat(at)
        kind = _KINDS.get(stat.S_IFMT(s.st_mode))
        target = os.readlink(at) if kind == "symlink" else None
    except OSError:
        return None
    device = kind in ("blk", "chr")
    known = dict.fromkeys(COLUMNS) | {
        "root": root,
        "path": path,
        "kind": kind,
        "size": s.st_size if kind == "file" else 0,
        "mtime_ns": s.st_mtime_ns,
        "atime_ns": s.st_atime_ns,
        "ctime_ns": s.st_ctime_ns,
        "mode": s.st_mode,
        "uid": s.st_uid,
        "gid": s.st_gid,
        "link_target": target,
        "rdev_major": os.major(s.st_rdev) if device else None,
        "rdev_minor": os.minor(s.st_rdev) if device else None,
    }
    return tuple(known[c] for c in COLUMNS)


def walk(path: str, at: str, root: str, exclude: set[str], follow: set[str], boundaries: list[str]) -> Iterator[tuple]:
    """Rows of the entry and all below it, parents first, without recursion. Excluded paths go with what is below."""
    todo = [(path, at)]
    while todo:
        path, at = todo.pop()
        if path in exclude:
            continue
        if path in follow and os.path.islink(at):
            at = resolve_symlink(at, boundaries) or at
        row = row_of(path, at, root)
        if row is None:
            continue
        yield row
        if row[2] == "dir":
            try:
                todo += [(f"{path}/{n}", os.path.join(at, n)) for n in sorted(os.listdir(at), reverse=True)]
            except OSError:
                continue


#: Entries with which a scan is content, levels that it opens for them, and tasks that they are dealt over at most.
ENOUGH = 32
OPEN_LEVELS = 4
MOST_PARTITIONS = 1024


class _Entry:
    """A place to walk, or alone a directory whose entries are walked by others."""

    def __init__(self, path: str, at: str, alone: bool = False):
        self.path, self.at, self.alone = path, at, alone


class _Entries(InputPartition):
    def __init__(self, entries: list[_Entry]):
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.top = os.path.abspath(options["path"])
        self.name = options.get("root", "repository")
        self.base = os.path.basename(self.top) if options.get("yieldroot") == "true" else ""
        self.exclude, self.follow = (set(json.loads(options.get(k, "[]"))) for k in ("exclude", "follow"))

    def _entries(self) -> list[_Entry]:
        """Top-level entries; where they are few, directories are opened level by level: a row each, and their entries."""
        if not os.path.isdir(self.top):
            return [_Entry(os.path.basename(self.top), self.top)]
        lead = self.base + "/" if self.base else ""
        opened, last = [], [_Entry(lead + n, os.path.join(self.top, n)) for n in sorted(os.listdir(self.top))]
        for _ in range(OPEN_LEVELS):
            plain = [e for e in last if e.path not in self.exclude and not os.path.islink(e.at) and os.path.isdir(e.at)]
            if not plain or len(opened) + len(last) >= ENOUGH:
                break
            inner = []
            for e in plain:
                try:
                    inner += [_Entry(f"{e.path}/{n}", os.path.join(e.at, n)) for n in sorted(os.listdir(e.at))]
                except OSError:
                    continue
            kept = {e.path for e in plain}
            opened += [e for e in last if e.path not in kept] + [_Entry(e.path, e.at, alone=True) for e in plain]
            last = inner
        return [*opened, *last]

    def partitions(self) -> list[_Entry]:
        entries = self._entries()
        if self.base and os.path.isdir(self.top):
            entries.insert(0, _Entry(self.base, self.top, alone=True))
        n = min(len(entries), MOST_PARTITIONS)
        return [_Entries(entries[i::n]) for i in range(n)] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        for e in partition.entries:
            if not e.alone:
                yield from walk(e.path, e.at, self.name, self.exclude, self.follow, [self.top])
            elif e.path not in self.exclude:
                row = row_of(e.path, e.at, self.name)
                if row:
                    yield row


class FileTree(DataSource):
    """Options: path, root, yieldRoot, and exclude and follow as JSON lists of paths."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def catalog_from_fs(spark: SparkSession, top: str, root: str = "repository", exclude: tuple[str, ...] = (), follow: tuple[str, ...] = (), yield_root: bool = False, digests: bool = True, digest_of: Callable[[DataFrame, str], DataFrame] = file_digests) -> DataFrame:
    """The catalog of a directory, or of a single file. With yield_root, paths start with the directory's own name.
    digest_of: adds the digest to files below a directory."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("filetree").option("path", top).option("root", root).option("yieldRoot", str(yield_root).lower())
    rows = reader.option("exclude", json.dumps(exclude)).option("follow", json.dumps(follow)).load()
    if not digests:
        return rows
    base = os.path.dirname(os.path.abspath(top)) if yield_root or not os.path.isdir(top) else os.path.abspath(top)
    files = digest_of(rows.where("kind = 'file'"), base)
    return rows.where("kind <> 'file'").unionByName(files.select(*COLUMNS))
