"""The index of a tree as a table: signatures, classes of equal content, refresh and import as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import below, parts, quoted, with_prefix, without_prefix
from ..functions.digest import with_equal_bytes
from ..functions.metadata import iso_micros

SIGNATURE = ["path", "digest", "mtime_ns", "ec_id"]


def signatures(catalog: DataFrame) -> DataFrame:
    """path, digest, mtime_ns, and what tells contents of one digest apart: content, if the catalog has it."""
    extra = ["content"] if "content" in catalog.columns else []
    return catalog.where("kind = 'file' and digest is not null").select("path", "digest", "mtime_ns", *extra)


def assign_ec(rows: DataFrame, existing: DataFrame | None = None, content: str | None = None) -> DataFrame:
    """rows with ec_id, the number of the content's class within its digest.

    content: a column by which contents are compared; without it digests are trusted and every class is 0. existing:
    (digest, ec_id and the content column) of classes that keep their numbers; new ones follow them. New classes are
    numbered by their first path, by components.
    """
    if content is None:
        return rows.withColumn("ec_id", F.lit(0))
    classes = rows.groupBy("digest", content).agg(F.min(parts(F.col("path"))).alias("first"))
    if existing is None:
        numbered = classes.withColumn("ec_id", F.row_number().over(Window.partitionBy("digest").orderBy("first")) - 1)
    else:
        known = existing.select("digest", content, F.col("ec_id").alias("known")).distinct()
        most = known.groupBy("digest").agg(F.max("known").alias("most"))
        found = classes.join(known, ["digest", content], "left").join(most, "digest", "left")
        fresh = F.row_number().over(Window.partitionBy("digest", F.col("known").isNull()).orderBy("first"))
        numbered = found.withColumn("ec_id", F.when(F.col("known").isNotNull(), F.col("known")).otherwise(F.coalesce("most", F.lit(-1)) + fresh))
    return rows.join(numbered.select("digest", content, F.col("ec_id").cast("int").alias("ec_id")), ["digest", content])


def class_heads(signed: DataFrame) -> DataFrame:
    """digest, ec_id, head: the first path of each class by components."""
    heads = signed.groupBy("digest", "ec_id").agg(F.min(parts(F.col("path"))).alias("head"))
    return heads.withColumn("head", F.array_join("head", "/"))


def ec_by_bytes(rows: DataFrame, root: str, kept: DataFrame | None = None) -> DataFrame:
    """rows (path, digest, ...) with ec_id, the class of files below root that have the same bytes within a digest.

    kept: signatures that keep their classes; rows join these where bytes agree. Files of a digest are compared with the
    first of each class, and those that are left make the next class, until none is left: one round, where digests do
    not collide. A digest of one file is not read. Files that can't be read any more drop out.
    """
    names = rows.columns
    heads = class_heads(kept if kept is not None else rows.sparkSession.createDataFrame([], "path string, digest string, ec_id int"))
    alone = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n = 1").join(heads, "digest", "left_anti").select("digest")
    done = rows.join(alone, "digest").select(*names, F.lit(0).alias("ec_id"))
    left, k = rows.join(alone, "digest", "left_anti").select(*names).persist(), 0
    while not left.isEmpty():
        fresh = left.join(heads.where(F.col("ec_id") >= k), "digest", "left_anti").groupBy("digest").agg(F.array_join(F.min(parts(F.col("path"))), "/").alias("right"))
        leads = heads.where(F.col("ec_id") == k).select("digest", F.col("head").alias("right")).unionByName(fresh)
        same = with_equal_bytes(left.join(leads, "digest").withColumn("left", F.col("path")), root, root).select(*names).persist()
        done = done.unionByName(same.withColumn("ec_id", F.lit(k)))
        rest = left.join(same.select("path"), "path", "left_anti").join(fresh.select(F.col("right").alias("path")), "path", "left_anti")
        left, k = rest.select(*names).persist(), k + 1
    return done


def classes_met(source: DataFrame, target: DataFrame, source_root: str, target_root: str) -> DataFrame:
    """digest, ec_id, own: the number in the target for each class of the source whose digest the target has; that of the
    class with the same bytes, by the first file of each that there still is, else a new one after the target's."""
    a = class_heads(source).withColumnRenamed("head", "left")
    b = class_heads(target).select("digest", F.col("ec_id").alias("own"), F.col("head").alias("right"))
    same = with_equal_bytes(a.join(b, "digest"), source_root, target_root).groupBy("digest", "ec_id").agg(F.min("own").alias("own"))
    most = b.groupBy("digest").agg(F.max("own").alias("most"))
    found = a.drop("left").join(most, "digest").join(same, ["digest", "ec_id"], "left")
    place = F.row_number().over(Window.partitionBy("digest", F.col("own").isNull()).orderBy("ec_id"))
    return found.select("digest", "ec_id", F.coalesce("own", F.col("most") + place).cast("int").alias("own"))


def lookup_classes(indexed: DataFrame, digest: str) -> DataFrame:
    """ec_id, path of the files of one digest: the filter reaches the table's scan."""
    return indexed.where(F.col("digest") == digest).select("ec_id", "path")


def ec_classes(signed: DataFrame) -> DataFrame:
    """digest, ec_id, paths: sorted by components, joined by |; n: how many."""
    listed = F.array_sort(F.collect_list(parts(F.col("path"))))
    per = signed.groupBy("digest", "ec_id").agg(listed.alias("p"), F.count(F.lit(1)).alias("n"))
    return per.select("digest", "ec_id", F.array_join(F.transform("p", lambda x: F.array_join(x, "/")), "|").alias("paths"), "n")


def duplicate_groups(signed: DataFrame) -> DataFrame:
    return ec_classes(signed).where("n > 1")


def refresh_plan(indexed: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """path, action, old and new columns for every path of either side: delete, insert, update or keep.

    A file is read again if its index entry is unfinished or older than the file. One whose time went back is kept, as
    ever; force reads all again.
    """
    old = indexed.select("path", F.col("digest").alias("old_digest"), F.col("mtime_ns").alias("old_mtime_ns"), F.col("ec_id").alias("old_ec_id"), F.lit(1).alias("was"))
    new = catalog.where("kind = 'file'").select("path", F.col("mtime_ns").alias("new_mtime_ns"), "digest", F.lit(1).alias("is"))
    stale = F.lit(force) | F.col("old_mtime_ns").isNull() | (F.col("old_mtime_ns") < F.col("new_mtime_ns")) | F.col("old_ec_id").isNull()
    action = F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull(), "insert").when(stale, "update").otherwise("keep")
    return old.join(new, "path", "full_outer").select("path", action.alias("action"), "old_digest", "old_mtime_ns", "old_ec_id", "digest", "new_mtime_ns")


def refresh_apply(indexed: DataFrame, catalog: DataFrame, force: bool = False) -> DataFrame:
    """The index after a refresh, digests trusted: kept rows as they are, inserted and updated ones anew in class 0."""
    plan = refresh_plan(indexed, catalog, force).where("action <> 'delete'")
    keep = F.col("action") == "keep"
    return plan.select("path", F.when(keep, F.col("old_digest")).otherwise(F.col("digest")).alias("digest"), F.when(keep, F.col("old_mtime_ns")).otherwise(F.col("new_mtime_ns")).alias("mtime_ns"), F.when(keep, F.col("old_ec_id")).otherwise(F.lit(0)).alias("ec_id"))


def upsert(indexed: DataFrame, rows: DataFrame) -> DataFrame:
    return indexed.join(rows.select("path"), "path", "left_anti").select(*SIGNATURE).unionByName(rows.select(*SIGNATURE))


def deregister(indexed: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the given paths; paths that aren't there don't matter."""
    return indexed.join(paths.select("path"), "path", "left_anti")


def import_signatures(target: DataFrame, source: DataFrame, prefix_add: str = "", prefix_strip: str = "", content: str | None = None, classes: DataFrame | None = None) -> DataFrame:
    """The target's index with the source's merged in.

    A nested source's paths get prefix_add; of a source above, paths below prefix_strip lose it and others drop out.
    Whole digests come over: those of which some path is not in the target yet. Classes with equal content (a column of
    both sides, or classes, from classes_met(); without either digests are trusted) take the target's number, new ones
    follow. Imported rows win over target rows of the same path.
    """
    extra = [content] if content else []
    moved = source.where(below(F.col("path"), prefix_strip)).withColumn("path", without_prefix(F.col("path"), prefix_strip)) if prefix_strip else source
    moved = moved.withColumn("path", with_prefix(F.col("path"), prefix_add)).select(*SIGNATURE, *extra)
    fresh = moved.join(target.select("path"), "path", "left_anti").select("digest").distinct()
    coming = moved.join(fresh, "digest", "left_semi")
    if content:
        numbered = assign_ec(coming.drop("ec_id"), target, content)
    elif classes is not None:
        numbered = coming.join(classes, ["digest", "ec_id"], "left").withColumn("ec_id", F.coalesce("own", "ec_id"))
    else:
        own = target.groupBy("digest").agg(F.min("ec_id").alias("own"))
        numbered = coming.join(own, "digest", "left").withColumn("ec_id", F.coalesce("own", "ec_id"))
    return upsert(target, numbered)


def inspect_lines(indexed: DataFrame, manifest: dict[str, str] | None = None) -> DataFrame:
    """One text line for each entry of the manifest, each path of a class, and each signature."""
    spark = indexed.sparkSession
    head = spark.createDataFrame([(f"manifest-property {k} {v}",) for k, v in (manifest or {}).items()], "line string")
    path = quoted(F.col("path"))
    hashes = indexed.select(F.concat(F.lit("file-hash "), F.col("digest"), F.lit(" ec_id:"), F.col("ec_id").cast("string"), F.lit(" "), path).alias("line"))
    files = indexed.select(F.concat(F.lit("file-metadata "), path, F.lit(" digest:"), F.col("digest"), F.lit(" mtime:"), iso_micros(F.col("mtime_ns")), F.lit("Z ec_id:"), F.col("ec_id").cast("string")).alias("line"))
    return head.unionByName(hashes).unionByName(files)
