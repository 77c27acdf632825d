"""A repository on disk: an index of Parquet versions with a JSON manifest, and reports beside analysed trees.

A new state of the index is written as a new version; the manifest, replaced in one step, names the one that counts.
"""

from __future__ import annotations

import json
import logging
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import ALGORITHMS, algorithm, file_digests, with_equal_bytes
from ..functions.rule import MatchRule
from ..sources.filesystem import catalog_from_fs
from ..sources.settings import IndexSettings
from . import analyze, index

LOG = logging.getLogger("twinset")
HOME = ".twinset"
REPORT = ".report"


class IndexNotFound(FileNotFoundError):
    pass


def find_repository(path: str) -> tuple[str, str] | None:
    """(root, path within it or .) of the nearest directory above, or the path itself, that has an index."""
    full = Path(os.path.normpath(os.path.abspath(path)))
    for at in (full, *full.parents):
        if (at / HOME).is_dir():
            return str(at), str(full.relative_to(at))
    return None


def find_report(path: str) -> tuple[str, str] | None:
    """(analysed target, path in its report) for the nearest target above, or the path itself, that has a report."""
    full = Path(os.path.normpath(os.path.abspath(path)))
    for at in (full, *full.parents):
        if at.name and Path(f"{at}{REPORT}").is_dir():
            return str(at), str(full.relative_to(at.parent))
    return None


def _write_json(path: Path, value: dict) -> None:
    temporary = path.with_suffix(f".{uuid.uuid4().hex}")
    temporary.write_text(json.dumps(value))
    os.replace(temporary, path)


class Repository:
    """algorithms: hash algorithms by name beside the built-in ones; follow: what decides which links are followed, from
    (path, target) to bool, in place of the list in the settings; bytes: whether contents of equal digest are compared
    byte by byte, else digests are trusted; listen: called with each message."""

    def __init__(self, spark: SparkSession, root: str, create: bool = False, algorithms: dict | None = None, follow: Callable[[str, str], bool] | None = None, bytes: bool = True, listen: Callable[[str], None] | None = None):
        self.spark, self.root = spark, Path(root)
        self.algorithms, self.follow, self.bytes, self.listen = ALGORITHMS | (algorithms or {}), follow, bytes, listen
        if not self.root.exists():
            raise FileNotFoundError(root)
        if not self.root.is_dir():
            raise NotADirectoryError(root)
        self.home = self.root / HOME
        if not self.home.is_dir():
            if not create:
                raise IndexNotFound(f"no index in {root}")
            self.home.mkdir()
        self.settings = IndexSettings(self.home)

    def say(self, message: str, level: int = logging.INFO) -> None:
        LOG.log(level, "%s: %s", self.root, message)
        if self.listen:
            self.listen(message)

    def _digests(self, files: DataFrame, root: str) -> DataFrame:
        return file_digests(files, root, self.manifest.get("hash-algorithm"), self.algorithms)

    @property
    def manifest(self) -> dict[str, str]:
        path = self.home / "manifest.json"
        return json.loads(path.read_text()) if path.is_file() else {}

    def signatures(self) -> DataFrame:
        version = self.manifest.get("version")
        if version is None:
            return self.spark.createDataFrame([], "path string, digest string, mtime_ns long, ec_id int")
        return self.spark.read.parquet(f"file://{self.home}/{version}")

    def _swap(self, rows: DataFrame, **properties: str) -> None:
        old, new = self.manifest, f"signatures-{uuid.uuid4().hex}"
        rows.select(*[F.col(c).cast(t) for c, t in (("path", "string"), ("digest", "string"), ("mtime_ns", "long"), ("ec_id", "int"))]).write.parquet(f"file://{self.home}/{new}")
        _write_json(self.home / "manifest.json", old | {"repository-id": old.get("repository-id") or str(uuid.uuid4())} | properties | {"version": new})
        if "version" in old:
            shutil.rmtree(self.home / old["version"], ignore_errors=True)

    def catalog(self, digests: bool = True) -> DataFrame:
        """The tree without the index at its top; links that follow takes, or the settings name, are followed."""
        return catalog_from_fs(self.spark, str(self.root), "repository", (HOME,), self.followed(), digests=digests, digest_of=self._digests)

    def followed(self) -> tuple[str, ...]:
        if self.follow is None:
            return tuple(self.settings.get("index.followed-symlinks", []))
        links = catalog_from_fs(self.spark, str(self.root), "repository", (HOME,), (), digests=False).where("kind = 'symlink'")
        return tuple(r["path"] for r in links.select("path", "link_target").toLocalIterator() if self.follow(r["path"], r["link_target"]))

    def _classes(self, rows: DataFrame, kept: DataFrame | None = None) -> DataFrame:
        return index.ec_by_bytes(rows, str(self.root), kept) if self.bytes else index.assign_ec(rows)

    def rebuild(self, hash_algorithm: str = "sha256") -> None:
        algorithm(hash_algorithm, self.algorithms)
        self.say(f"rebuilding with {hash_algorithm}")
        self._swap(self.spark.createDataFrame([], "path string, digest string, mtime_ns long, ec_id int"), **{"hash-algorithm": hash_algorithm})
        self._swap(self._classes(index.signatures(self.catalog()).select("path", "digest", "mtime_ns")))
        self.say("rebuilt")

    def refresh(self, force: bool = False) -> None:
        """Only files that are new or newer than their entry are read."""
        algorithm(self.manifest.get("hash-algorithm"), self.algorithms)
        self.say("refreshing")
        plan = index.refresh_plan(self.signatures(), self.catalog(digests=False), force)
        again = plan.where("action in ('insert', 'update')").select("path", F.col("new_mtime_ns").alias("mtime_ns"))
        read = self._digests(again, str(self.root)).where("digest is not null").persist()
        kept = plan.where("action = 'keep'").select("path", F.col("old_digest").alias("digest"), F.col("old_mtime_ns").alias("mtime_ns"), F.col("old_ec_id").alias("ec_id"))
        self._swap(kept.unionByName(self._classes(read, kept).select(*index.SIGNATURE)))
        self.say("refreshed")

    def import_index(self, source: str) -> None:
        """Merges the index of a repository nested in this one, or of one that this one is nested in."""
        other = Repository(self.spark, source)
        a, b = self.root.resolve(), other.root.resolve()
        if a == b:
            raise ValueError("a repository can't be imported into itself")
        if HOME in b.parts or HOME in a.parts:
            raise ValueError("a repository can't lie within an index")
        outer, inner = (self, other) if a in b.parents else (other, self)
        outer.check_reachable(inner.root)
        add = b.relative_to(a).as_posix() if a in b.parents else ""
        strip = a.relative_to(b).as_posix() if b in a.parents else ""
        if not add and not strip:
            raise ValueError("the repositories must be nested")
        mine, theirs = self.manifest.get("hash-algorithm"), other.manifest.get("hash-algorithm")
        if mine and theirs and mine != theirs:
            raise ValueError(f"hash algorithms differ: {mine}, {theirs}")
        classes = index.classes_met(other.signatures(), self.signatures(), str(other.root), str(self.root)) if self.bytes else None
        self.say(f"importing {source}")
        self._swap(index.import_signatures(self.signatures(), other.signatures(), add, strip, classes=classes), **({"hash-algorithm": mine or theirs} if mine or theirs else {}))

    def check_reachable(self, inner: Path) -> None:
        """Raises unless a walk of this repository comes by the inner one: no link on the way that is not followed."""
        try:
            way = Path(os.path.abspath(inner)).relative_to(os.path.abspath(self.root))
        except ValueError:  # it is only within this one by links that lead here
            raise ValueError(f"{inner} is reached through a link that is not followed") from None
        at, followed = self.root, None
        for name in way.parts:
            at = at / name
            if not os.path.lexists(at):
                raise ValueError(f"{at} is not there")
            if at.is_symlink():
                followed = set(self.followed()) if followed is None else followed
                if at.relative_to(self.root).as_posix() not in followed:
                    raise ValueError(f"{at} is a link that is not followed")

    def analyze(self, paths: list[str], rule: MatchRule = MatchRule()) -> list[str]:
        """Writes a report beside each path, in place of an older one. Files that are gone since indexing drop out."""
        if "repository-id" not in self.manifest:
            raise RuntimeError("the index has not been built")
        tree = self.catalog(digests=False)
        signed = self.signatures()
        known = tree.drop("digest").join(signed.select("path", "digest", "ec_id"), "path", "left")
        there = signed.join(tree.where("kind = 'file'").select("path"), "path", "left_semi")
        reports = []
        for path in paths:
            full = os.path.normpath(os.path.abspath(path))
            self.say(f"analysing {full}")
            analyzed = catalog_from_fs(self.spark, full, "analyzed", yield_root=True, digest_of=self._digests).persist()
            keys: tuple[str, ...] = ("digest",)
            if self.bytes:  # a file's class is that whose first file has its bytes
                heads = index.class_heads(there)
                pairs = analyzed.where("kind = 'file'").select(F.col("path").alias("left"), "digest").join(heads.withColumnRenamed("head", "right"), "digest")
                found = with_equal_bytes(pairs, os.path.dirname(full), str(self.root)).groupBy(F.col("left").alias("path")).agg(F.min("ec_id").alias("ec_id"))
                analyzed, keys = analyzed.join(found, "path", "left").persist(), ("digest", "ec_id")
            reports.append(write_report(analyze.analyze(analyzed, known, rule, keys), full, self, rule))
            self.say(f"wrote {reports[-1]}")
        return reports

    def truncate(self) -> None:
        """Empties the index; its properties stay."""
        self._swap(self.signatures().limit(0))

    def lookup(self, digest: str) -> dict[int, list[str]]:
        """The paths of each class of a digest."""
        out: dict[int, list[str]] = {}
        for r in index.lookup_classes(self.signatures(), digest).orderBy("ec_id", "path").toLocalIterator():
            out.setdefault(r["ec_id"], []).append(r["path"])
        return out

    def inspect(self) -> Iterator[str]:
        shown = {k: v for k, v in self.manifest.items() if k != "version"}
        return (r["line"] for r in index.inspect_lines(self.signatures(), shown).toLocalIterator())


def write_report(rows: DataFrame, target: str, repository: Repository, rule: MatchRule) -> str:
    folder = Path(target + REPORT)
    folder.mkdir(exist_ok=True)
    rows.write.mode("overwrite").parquet(f"file://{folder}/records")
    _write_json(folder / "manifest.json", {"version": "1.0", "repository_path": str(repository.root), "repository_id": repository.manifest["repository-id"], "timestamp": datetime.now(timezone.utc).isoformat(), "comparison_rule": rule.to_dict()})
    return str(folder)


def read_report(spark: SparkSession, target: str) -> tuple[DataFrame, dict]:
    folder = Path(target + REPORT)
    return spark.read.parquet(f"file://{folder}/records"), json.loads((folder / "manifest.json").read_text())


def report_is_valid(target: str, repository: Repository) -> bool:
    """Whether the report was made with this repository; false where it is missing or can't be read."""
    try:
        return json.loads(Path(target + REPORT, "manifest.json").read_text())["repository_id"] == repository.manifest.get("repository-id")
    except (OSError, ValueError, KeyError):
        return False
