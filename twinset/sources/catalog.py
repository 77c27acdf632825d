"""The catalog: one row per node of a tree, whether it comes from a file system or from a table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import content_digest
from ..functions.paths import ancestors, parts

SCHEMA = (
    "root string, path string, kind string, size long, mtime_ns long, atime_ns long, ctime_ns long, mode long, uid long, gid long, "
    "link_target string, rdev_major int, rdev_minor int, digest string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Metadata of directories that a table implies but does not list.
DIRECTORY = {"mtime_ns": 0, "atime_ns": 0, "ctime_ns": 0, "mode": 16877, "uid": 1000, "gid": 100}
SPECIAL = ("symlink", "blk", "chr", "fifo", "sock")


def catalog_from_table(df: DataFrame, path: Column, content: Column, root: str, meta: dict[str, Column] | None = None, algorithm: str = "sha256") -> DataFrame:
    """A catalog of regular files, from a row each, and of the directories that their paths imply."""
    given = {"mtime_ns": F.lit(0), "atime_ns": F.lit(0), "ctime_ns": F.lit(0), "mode": F.lit(33188), "uid": F.lit(1000), "gid": F.lit(100)} | (meta or {})
    files = df.select(
        F.lit(root).alias("root"),
        path.alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length(content).cast("long").alias("size"),
        *[v.cast("long").alias(k) for k, v in given.items()],
        F.lit(None).cast("string").alias("link_target"),
        F.lit(None).cast("int").alias("rdev_major"),
        F.lit(None).cast("int").alias("rdev_minor"),
        content_digest(content, algorithm).alias("digest"),
    )
    return with_directories(files)


def with_directories(files: DataFrame) -> DataFrame:
    folders = files.select("root", F.explode(ancestors(parts(F.col("path")))).alias("path")).distinct()
    known = {"kind": F.lit("dir"), "size": F.lit(0).cast("long"), "digest": F.lit(None).cast("string")} | {k: F.lit(v).cast("long") for k, v in DIRECTORY.items()}
    kinds = dict(files.dtypes)
    rest = {c: F.lit(None).cast(kinds[c]) for c in files.columns if c not in known and c not in ("root", "path")}
    return files.unionByName(folders.select("root", "path", *[v.alias(k) for k, v in (known | rest).items()]))


def catalog_of(spark, rows: list[dict], root: str = "repository", missing_directories: bool = True) -> DataFrame:
    """A catalog in memory, for tests: rows with at least path; files may have content, which gives size and digest."""
    import hashlib

    out = []
    for given in rows:
        row = dict.fromkeys(COLUMNS) | {"root": root, "kind": "file", "size": 0} | DIRECTORY | given
        if row["kind"] == "file":
            content = given.get("content", b"")
            row |= {"size": len(content), "digest": given.get("digest") or hashlib.sha256(content).hexdigest()}
        out.append(tuple(row[c] for c in COLUMNS))
    df = spark.createDataFrame(out, SCHEMA)
    if not missing_directories:
        return df
    full = with_directories(df)
    listed = df.where("kind <> 'file'").select("path").distinct()
    implied = full.join(df.select("path"), "path", "left_anti")
    return df.unionByName(implied.join(listed, "path", "left_anti").select(*COLUMNS))
