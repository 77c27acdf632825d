"""Ranked views of records and matches, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metadata import human_size, percentage
from ..functions.paths import base_name, parent, parts
from ..functions.rule import FLAGS

SORTS = ("size", "items", "identical", "path")
CHILD_SORTS = ("dup-size", "dup-items", "total-size", "name")


def match_rank() -> Column:
    return F.when(F.col("is_identical"), 2).when(F.col("is_superset"), 1).otherwise(0)


def duplicate_order(sort_by: str) -> list[Column]:
    """Unknown names sort by size. Ties end with the path by its components."""
    rank, short = match_rank().desc(), F.length("dup_path").asc()
    order = {"items": [F.desc("duplicated_items"), rank, short], "identical": [rank, short], "path": [short, rank]}.get(sort_by, [F.desc("duplicated_size"), rank, short])
    return [*order, parts(F.col("dup_path")).asc()]


def describe_duplicates(matches: DataFrame, sort_by: str = "size", limit: int | None = 1) -> DataFrame:
    """Matches with their place, from 1, in each record; the first `limit` of each, or all."""
    ranked = matches.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy(*duplicate_order(sort_by))))
    return ranked if limit is None else ranked.where(F.col("place") <= limit)


def best_match(matches: DataFrame) -> DataFrame:
    """Each record's largest match and number of matches."""
    best = describe_duplicates(matches, "size", 1).select("path", F.col("dup_path").alias("best_path"), F.col("duplicated_size").alias("best_size"), match_rank().alias("best_rank"))
    return best.join(matches.groupBy("path").agg(F.count(F.lit(1)).alias("n_duplicates")), "path")


def shares(rows: DataFrame) -> DataFrame:
    """rows (total_size, total_items, duplicated_size, duplicated_items, best_size) with size_ratio, items_ratio and
    max_ratio from 0 to 1; 0 where the total is 0 or there is no record."""
    of = lambda part, whole: F.coalesce(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)), F.lit(0.0))
    return rows.withColumns({"size_ratio": of("duplicated_size", "total_size"), "items_ratio": of("duplicated_items", "total_items"), "max_ratio": of("best_size", "total_size")})


def describe_rows(named: DataFrame, record_rows: DataFrame) -> DataFrame:
    """named (path, name, kind, ...) with the totals, shares and largest match of each path's record, and in_report."""
    totals = record_rows.select("path", "total_size", "total_items", "duplicated_size", "duplicated_items", F.lit(True).alias("has"))
    best = best_match(record_rows.select("path", F.explode("duplicates").alias("m")).select("path", "m.*"))
    rows = named.join(totals, "path", "left").join(best, "path", "left")
    return shares(rows.withColumn("in_report", F.coalesce("has", F.lit(False))).drop("has"))


#: Heads of the table of records and whether a column stands at the right.
TABLE = [("Name", False), ("Type", False), ("Total Size", True), ("Dup Size", True), ("Size %", True), ("Total Items", True), ("Dup Items", True), ("Items %", True), ("Dups", True), ("Max Match", True), ("Max %", True), ("Status", False), ("In Report", False)]


def describe_cells(row: dict, in_bytes: bool = False) -> list[str]:
    """The cells of one of describe_rows(), as in TABLE."""
    size = str if in_bytes else human_size
    kind = "Dir" if row["kind"] == "dir" else "File"
    if not row["in_report"]:
        return [row["name"], kind, "-", size(0), "-", "-", "-", "-", "0", size(0), "-", "-", "No"]
    total, items, best = row["total_size"], row["total_items"], row["best_size"] or 0
    status = "-" if row["best_rank"] is None else ("Partial", "Superset", "Identical")[row["best_rank"]]
    shown = [size(total), size(row["duplicated_size"]), percentage(row["duplicated_size"], total), str(items), str(row["duplicated_items"]), percentage(row["duplicated_items"], items)]
    return [row["name"], kind, *shown, str(row["n_duplicates"] or 0), size(best), percentage(best, total), status, "Yes"]


#: What `describe --details` says first.
DEFINITIONS = """Terms
  Total: all files and special items at or below the path; directories are no items.
  Duplicated (Dup): of these, what has a copy anywhere in the repository, each once.
  Unique: the rest.
  Match: one place in the repository. Its size and items count what lies at the same place within it.
  Status: Identical, all is there with equal metadata; Superset, all is there, and more; Partial, some is missing.
  Matching: the metadata that agree, of mtime, atime, ctime, mode, owner and group.
Columns
  Size %, Items %: duplicated of total. Dups: number of matches. Max Match, Max %: the largest match's size and share.
  Status: of the largest match. In Report: No for what has no duplicate."""


def describe_children(totals: DataFrame, catalog: DataFrame, folder: str, sort_children: str = "dup-size") -> DataFrame:
    """The children of a folder with their records, and their place in the order. Children without a record have nulls.

    totals: path, total_size, total_items, duplicated_size, duplicated_items, n_duplicates. "dup-items" sorts by the
    number of duplicates, as it always has.
    """
    p = parts(F.col("path"))
    names = catalog.where(parent(p) == folder).select("path", base_name(p).alias("name"), "kind")
    rows = names.join(totals, "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).desc()
    order = {
        "dup-items": [zero("n_duplicates"), zero("duplicated_size"), zero("total_size")],
        "total-size": [zero("total_size")],
        "name": [],
    }.get(sort_children, [zero("duplicated_size"), zero("n_duplicates"), zero("total_size")])
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order, "name")))


def child_key(sort_children: str):
    """The order of describe_children() for collected rows of describe_rows()."""
    n = lambda r, c: -(r[c] or 0)
    return {
        "dup-items": lambda r: (n(r, "n_duplicates"), n(r, "duplicated_size"), n(r, "total_size"), r["name"]),
        "total-size": lambda r: (n(r, "total_size"), r["name"]),
        "name": lambda r: (r["name"],),
    }.get(sort_children, lambda r: (n(r, "duplicated_size"), n(r, "n_duplicates"), n(r, "total_size"), r["name"]))


def status_text(is_dir: bool, row: dict) -> str:
    if is_dir:
        return "Identical" if row["is_identical"] else "Superset" if row["is_superset"] else "Partial match"
    return "Identical" if row["is_identical"] else "Content match"


def print_duplicates(record: dict, is_dir: bool, sort_by: str = "size", limit: int | None = 1, in_bytes: bool = False) -> str:
    """The text for one record, as collected: totals, then the matches in order."""
    size = (lambda n: f"{n} bytes") if in_bytes else human_size
    unique = record["total_size"] - record["duplicated_size"]
    lines = [
        record["path"],
        f"Total: {size(record['total_size'])}, {record['total_items']} items",
        f"Duplicated: {size(record['duplicated_size'])} ({percentage(record['duplicated_size'], record['total_size'])}), {record['duplicated_items']} items",
        f"Unique: {size(unique)}, {record['total_items'] - record['duplicated_items']} items",
    ]
    rank = lambda m: 2 if m["is_identical"] else 1 if m["is_superset"] else 0
    keys = {
        "items": lambda m: (-m["duplicated_items"], -rank(m), len(m["dup_path"])),
        "identical": lambda m: (-rank(m), len(m["dup_path"])),
        "path": lambda m: (len(m["dup_path"]), -rank(m)),
    }
    by = keys.get(sort_by, lambda m: (-m["duplicated_size"], -rank(m), len(m["dup_path"])))
    found = sorted(record["duplicates"], key=lambda m: (by(m), m["dup_path"].split("/")))
    shown = found if limit is None else found[:limit]
    if len(shown) < len(found):
        lines.append(f"Showing {len(shown)} of {len(found)}")
    for m in shown:
        lines.append(f"{m['dup_path']}: {status_text(is_dir, m)}")
        if not m["is_identical"]:
            lines.append("  Matching: " + ", ".join(f.removesuffix("_match") for f in FLAGS if m[f]))
        if m["duplicated_size"]:
            lines.append(f"  Duplicated size: {size(m['duplicated_size'])}")
        if m["duplicated_items"]:
            lines.append(f"  Duplicated items: {m['duplicated_items']}")
    return "\n".join(lines)


def print_table(rows: list[list[str]], heads: list[tuple[str, bool]]) -> str:
    """Columns as wide as their widest cell, two blanks apart, a rule under the heads."""
    cells = [[h for h, _ in heads], *rows]
    widths = [max(len(row[i]) for row in cells) for i in range(len(heads))]
    shown = ["  ".join(x.rjust(w) if right else x.ljust(w) for x, w, (_, right) in zip(row, widths, heads)).rstrip() for row in cells]
    return "\n".join([shown[0], "  ".join("-" * w for w in widths), *shown[1:]])
