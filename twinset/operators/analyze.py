"""Which files and directories of one tree another tree already has.

The directory part is one aggregate and no iteration: every contribution to a pair of directories is an AND or a sum.
Contributions are file pairs, the pairs of directories themselves, and items that are neither files nor directories;
each counts for its own pair and, as far as the last path components agree, for the pairs above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, common_suffix, joined, parent, parts, prefixes, without_last
from ..functions.rule import FLAGS, MatchRule, compared
from ..sources.catalog import SPECIAL

MATCH_COLUMNS = ["path", "dup_path", *FLAGS, "duplicated_size", "duplicated_items", "is_identical", "is_superset"]


def file_matches(analyzed: DataFrame, repository: DataFrame, rule: MatchRule = MatchRule(), keys: tuple[str, ...] = ("digest",)) -> DataFrame:
    """A row for each analysed file and each repository file of the same content.

    keys: columns that must agree; add ec_id where digests collide and classes are numbered on both sides.
    """
    a = analyzed.where("kind = 'file'").alias("a")
    b = repository.where("kind = 'file'").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    pairs = a.join(b, on).select(F.col("a.path").alias("path"), F.col("b.path").alias("dup_path"), *compared(), F.col("a.size").alias("duplicated_size"), F.lit(1).cast("long").alias("duplicated_items"))
    return pairs.withColumn("is_identical", rule.holds()).withColumn("is_superset", F.col("is_identical")).select(*MATCH_COLUMNS)


def same_name_matches(analyzed: DataFrame, repository: DataFrame, rule: MatchRule = MatchRule(), keys: tuple[str, ...] = ("digest",)) -> DataFrame:
    """The file matches with equal base names: all that directories need. Copies of common contents, such as empty files,
    meet by name here, not each with each."""
    a, b = (t.withColumn("name", base_name(parts(F.col("path")))) for t in (analyzed, repository))
    return file_matches(a, b, rule, (*keys, "name"))


def matched_files(analyzed: DataFrame, repository: DataFrame, keys: tuple[str, ...] = ("digest",)) -> DataFrame:
    return analyzed.where("kind = 'file'").join(repository.where("kind = 'file'").select(*keys).distinct(), list(keys), "left_semi").select("path")


def unmatched_files(analyzed: DataFrame, repository: DataFrame, keys: tuple[str, ...] = ("digest",)) -> DataFrame:
    files = analyzed.where("kind = 'file'")
    return files.join(repository.where("kind = 'file'").select(*keys).distinct(), list(keys), "left_anti")


def directory_pairs(matches: DataFrame) -> DataFrame:
    """(d, e): directories above a file match at an equal distance with equal names in between. The repository's root
    and what lies above the analysed target never pair. Matches whose base names differ drop out before the explode."""
    a, b = parts(F.col("path")), parts(F.col("dup_path"))
    near = matches.select(a.alias("a"), b.alias("b")).withColumn("deep", common_suffix(F.col("a"), F.col("b"))).where("deep > 0")
    each = near.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("deep"))))
    return each.select(without_last(F.col("a"), F.col("k")).alias("d"), without_last(F.col("b"), F.col("k")).alias("e")).distinct()


def _children(catalog: DataFrame) -> DataFrame:
    p = parts(F.col("path"))
    return catalog.select(parent(p).alias("dir"), base_name(p).alias("name"), F.col("path").alias("child"), "kind").where("dir is not null")


def deferred_children(analyzed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(d, t): children of matched directories through which a special item is reached whose nearest matched directory
    is d: the item itself, or an unmatched directory that holds it."""
    special = analyzed.where(F.col("kind").isin(*SPECIAL)).select("path")
    up = special.withColumn("p", parts(F.col("path"))).select("path", "p", F.explode(ancestors(F.col("p"))).alias("d"))
    nearest = up.join(pairs.select("d").distinct(), "d").groupBy("path").agg(F.max_by("d", F.length("d")).alias("d"), F.first("p").alias("p"))
    depth = F.size(parts(F.col("d")))
    return nearest.select("d", joined(F.slice("p", F.lit(1), depth + 1)).alias("t")).distinct()


def _name_sets(pairs: DataFrame, analyzed: DataFrame, repository: DataFrame) -> DataFrame:
    """(d, e, n_d, n_e, n_both): how many child names each has and both have."""
    a, b = _children(analyzed), _children(repository)
    left = pairs.join(a.select(F.col("dir").alias("d"), "name"), "d", "left")
    both = left.join(b.select(F.col("dir").alias("e"), "name", F.lit(1).alias("hit")), ["e", "name"], "left")
    counts = both.groupBy("d", "e").agg(F.count("name").alias("n_d"), F.count("hit").alias("n_both"))
    return counts.join(b.groupBy(F.col("dir").alias("e")).agg(F.count(F.lit(1)).alias("n_e")), "e", "left").fillna(0, ["n_e"])


def has_special(analyzed: DataFrame) -> bool:
    """Whether there is any item that is neither file nor directory; trees without one need no deferred part."""
    return not analyzed.where(F.col("kind").isin(*SPECIAL)).isEmpty()


def local_flags(pairs: DataFrame, matches: DataFrame, analyzed: DataFrame, repository: DataFrame, deferred: DataFrame | None) -> DataFrame:
    """(d, e, not_identical, not_superset) from child names alone: whether names differ, and whether a child of d is
    neither matched within e nor deferred."""
    known = matches.select(F.col("path").alias("child"), F.col("dup_path").alias("other")).unionByName(pairs.select(F.col("d").alias("child"), F.col("e").alias("other"))).distinct()
    each = pairs.join(_children(analyzed).select(F.col("dir").alias("d"), "name", "child"), "d").withColumn("other", F.concat_ws("/", "e", "name"))
    each = each.join(repository.select(F.col("path").alias("other"), F.lit(1).alias("there")), "other", "left")
    each = each.join(known.withColumn("matched", F.lit(1)), ["child", "other"], "left")
    waiting = F.lit(None)
    if deferred is not None:
        each = each.join(deferred.select("d", F.col("t").alias("child"), F.lit(1).alias("waiting")), ["d", "child"], "left")
        waiting = F.col("waiting")
    sets = each.groupBy("d", "e").agg(F.count(F.lit(1)).alias("n_d"), F.count("there").alias("n_both"), F.bool_or(F.col("matched").isNull() & waiting.isNull()).alias("missed"))
    sets = sets.join(_children(repository).groupBy(F.col("dir").alias("e")).agg(F.count(F.lit(1)).alias("n_e")), "e")
    subset = F.col("n_both") == F.col("n_d")
    return sets.select("d", "e", (~subset | (F.col("n_e") != F.col("n_d")) | F.col("missed")).alias("not_identical"), (~subset | F.col("missed")).alias("not_superset"))


def deferred_items(pairs: DataFrame, analyzed: DataFrame, repository: DataFrame, deferred: DataFrame, strict: bool = False) -> DataFrame:
    """What items at or below deferred children contribute to (d, e): special items that e has at the same place, of the
    same kind and, for links and devices, with the same target or numbers; and directories, by the names in them.

    What is missing or different contributes nothing, unless strict: then it makes the pair neither identical nor a
    superset. Regular files below deferred children contribute nothing.
    """
    nodes = analyzed.where("kind <> 'file'")
    at = nodes.select("path", F.explode(prefixes(parts(F.col("path")))).alias("t"))
    wanted = deferred.join(at, "t").join(pairs, "d").withColumn("other", F.concat("e", F.substring("path", F.length("d") + 1, F.length("path"))))
    a, b = nodes.alias("a"), repository.where("kind <> 'file'").alias("b")
    devices = F.col("a.rdev_major").eqNullSafe(F.col("b.rdev_major")) & F.col("a.rdev_minor").eqNullSafe(F.col("b.rdev_minor"))
    same = (F.col("a.kind") == F.col("b.kind")) & F.when(F.col("a.kind") == "symlink", F.col("a.link_target").eqNullSafe(F.col("b.link_target"))).when(F.col("a.kind").isin("blk", "chr"), devices).otherwise(True)
    found = wanted.alias("w").join(a, F.col("w.path") == F.col("a.path")).join(b, (F.col("w.other") == F.col("b.path")) & same, "left")
    hit = F.col("b.path").isNotNull()
    found = found if strict else found.where(hit)
    rows = found.select("w.d", "w.e", F.col("w.path").alias("x"), F.col("w.other").alias("y"), F.col("a.kind").alias("kind"), hit.alias("hit"), *compared())
    sets = _name_sets(rows.where("kind = 'dir' and hit").select(F.col("x").alias("d"), F.col("y").alias("e")).distinct(), analyzed, repository).withColumnsRenamed({"d": "x", "e": "y"})
    rows = rows.join(sets, ["x", "y"], "left")
    folder = F.col("n_d").isNotNull()
    return rows.select(
        "d",
        "e",
        "x",
        "hit",
        *[F.coalesce(f, F.lit(True)).alias(f) if strict else F.col(f) for f in FLAGS],
        F.when((F.col("kind") != "dir") & F.col("hit"), 1).otherwise(0).cast("long").alias("items"),
        (~F.col("hit") | (folder & ((F.col("n_both") != F.col("n_d")) | (F.col("n_e") != F.col("n_d"))))).alias("not_identical"),
        (~F.col("hit") | (folder & (F.col("n_both") != F.col("n_d")))).alias("not_superset"),
    )


def dir_matches(analyzed: DataFrame, repository: DataFrame, matches: DataFrame, rule: MatchRule = MatchRule(), strict_specials: bool = False) -> DataFrame:
    """Matches of directories, in the columns of file matches. matches: the file matches of the two catalogs, of which
    those with equal base names count (same_name_matches() gives no others).

    duplicated_size and duplicated_items count what lies at the same place within that one repository directory.
    """
    matches = matches.persist()  # both are used several times; they go with their blocks when no longer needed
    pairs = directory_pairs(matches).persist()
    deferred = deferred_children(analyzed, pairs) if has_special(analyzed) else None
    flags = local_flags(pairs, matches, analyzed, repository, deferred)
    dirs = pairs.join(analyzed.alias("a"), F.col("d") == F.col("a.path")).join(repository.alias("b"), F.col("e") == F.col("b.path")).select("d", "e", *compared())
    none = F.lit(0).cast("long")
    own = dirs.join(flags, ["d", "e"]).select("d", "e", *FLAGS, none.alias("size"), none.alias("items"), "not_identical", "not_superset")
    # a file pair stands below its directories: its own pair is one component further up
    files = matches.select(F.col("path").alias("d"), F.col("dup_path").alias("e"), *FLAGS, F.col("duplicated_size").alias("size"), F.col("duplicated_items").alias("items"), F.lit(False).alias("not_identical"), F.lit(False).alias("not_superset"))
    special = None if deferred is None else deferred_items(pairs, analyzed, repository, deferred, strict_specials).select("d", "e", *FLAGS, none.alias("size"), "items", "not_identical", "not_superset")

    def lifted(rows: DataFrame, lowest: int) -> DataFrame:
        rows = rows.withColumn("a", parts(F.col("d"))).withColumn("b", parts(F.col("e"))).withColumn("deep", common_suffix(F.col("a"), F.col("b"))).where(F.col("deep") >= lowest)
        each = rows.withColumn("k", F.explode(F.sequence(F.lit(lowest), F.col("deep"))))
        return each.withColumn("d", without_last(F.col("a"), F.col("k"))).withColumn("e", without_last(F.col("b"), F.col("k"))).drop("a", "b", "deep", "k")

    all_rows = lifted(files, 1).unionByName(lifted(own, 0))
    if special is not None:
        all_rows = all_rows.unionByName(lifted(special, 0))
    good = rule.holds()
    folded = all_rows.groupBy("d", "e").agg(
        *[F.bool_and(f).alias(f) for f in FLAGS],
        F.sum("size").alias("duplicated_size"),
        F.sum("items").alias("duplicated_items"),
        F.bool_and(good & ~F.col("not_identical")).alias("is_identical"),
        F.bool_and(good & ~F.col("not_superset")).alias("is_superset"),
    )
    return folded.withColumnsRenamed({"d": "path", "e": "dup_path"}).select(*MATCH_COLUMNS)


def dir_totals(analyzed: DataFrame, matched_files: DataFrame) -> DataFrame:
    """path, total_size, total_items, duplicated_size, duplicated_items of every directory that holds something.

    matched_files: (path) of files with a copy anywhere. Directories are no items; special items have no size.
    """
    items = analyzed.where("kind <> 'dir'").join(matched_files.select("path").distinct().withColumn("hit", F.lit(1)), "path", "left")
    up = items.select("size", "hit", F.explode(ancestors(parts(F.col("path")))).alias("up"))
    hit = F.col("hit").isNotNull()
    return up.groupBy(F.col("up").alias("path")).agg(
        F.sum("size").alias("total_size"),
        F.count(F.lit(1)).alias("total_items"),
        F.sum(F.when(hit, F.col("size")).otherwise(0)).alias("duplicated_size"),
        F.sum(F.when(hit, 1).otherwise(0)).cast("long").alias("duplicated_items"),
    )


def _with_special(totals: DataFrame, analyzed: DataFrame, repository: DataFrame, dirs: DataFrame) -> DataFrame:
    """Adds an item for each special item and directory that finds it at its place in some matched directory."""
    pairs = dirs.select(F.col("path").alias("d"), F.col("dup_path").alias("e"))
    found = deferred_items(pairs, analyzed, repository, deferred_children(analyzed, pairs)).where("items > 0").select("d", "x").distinct()
    more = found.select(F.explode(prefixes(parts(F.col("d")))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("more"))
    return totals.join(more, "path", "left").withColumn("duplicated_items", F.col("duplicated_items") + F.coalesce("more", F.lit(0))).drop("more")


def records(analyzed: DataFrame, repository: DataFrame, files: DataFrame, dirs: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """A record for each matched file and directory: path, its totals, and its matches as an array.

    files, dirs: from file_matches and dir_matches; matched: from matched_files, else told from files. A file counts
    once, wherever its copies are.
    """
    dirs = dirs.persist()
    totals = dir_totals(analyzed, files if matched is None else matched)
    if has_special(analyzed):
        totals = _with_special(totals, analyzed, repository, dirs)
    match = F.struct(*MATCH_COLUMNS[1:])
    listed = lambda m: m.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(parts(F.col("dup_path")).alias("order"), match.alias("match")))).getField("match").alias("duplicates"))
    names = ["path", "total_size", "total_items", "duplicated_size", "duplicated_items", "duplicates"]
    one = F.lit(1).cast("long")
    of_files = listed(files).join(analyzed.select("path", F.col("size").alias("total_size")), "path").select("path", "total_size", one.alias("total_items"), F.col("total_size").alias("duplicated_size"), one.alias("duplicated_items"), "duplicates")
    return of_files.unionByName(listed(dirs).join(totals, "path").select(*names))


def matches_of(record_rows: DataFrame) -> DataFrame:
    """The matches within records, a row each."""
    return record_rows.select("path", F.explode("duplicates").alias("m")).select("path", "m.*")


def analyze(analyzed: DataFrame, repository: DataFrame, rule: MatchRule = MatchRule(), keys: tuple[str, ...] = ("digest",)) -> DataFrame:
    files = file_matches(analyzed, repository, rule, keys)
    dirs = dir_matches(analyzed, repository, same_name_matches(analyzed, repository, rule, keys), rule)
    return records(analyzed, repository, files, dirs, matched_files(analyzed, repository, keys))
