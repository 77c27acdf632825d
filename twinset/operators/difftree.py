"""Comparison of an analysed directory with a repository directory, as a table and as a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parts, prefixes
from ..functions.rule import MatchRule
from . import analyze

MARKS = {"ANALYZED_ONLY": " [A]", "REPOSITORY_ONLY": " [R]", "DIFFERENT": " [D]", "CONTENT_MATCH": " [M]", "SUPERSET": " [+]", "IDENTICAL": ""}


def _below(catalog: DataFrame, start: str) -> DataFrame:
    inside = catalog.where((F.col("path") == start) | F.col("path").startswith(start + "/"))
    return inside.select(F.substring("path", F.lit(len(start) + 2), F.length("path")).alias("rel"), "path", "kind")


def node_status(analyzed: DataFrame, repository: DataFrame, matches: DataFrame, totals: DataFrame, start: str, against: str) -> DataFrame:
    """rel, kind, status of every node of either tree below start and against; rel is empty for these two themselves.

    totals: path, total_items of the records. kind is the analysed side's where there is one.
    """
    a = _below(analyzed, start).select("rel", F.col("path").alias("path"), F.col("kind").alias("a_kind"))
    b = _below(repository, against).select("rel", F.col("path").alias("dup_path"), F.col("kind").alias("b_kind"))
    both = a.join(b, "rel", "full_outer")
    known = matches.select("path", "dup_path", "is_identical", "is_superset", F.col("duplicated_items").alias("n"))
    rows = both.join(known, ["path", "dup_path"], "left").join(totals.select("path", "total_items"), "path", "left")
    status = (
        F.when(F.col("path").isNull(), "REPOSITORY_ONLY")
        .when(F.col("dup_path").isNull(), "ANALYZED_ONLY")
        .when(F.col("is_identical").isNull(), "DIFFERENT")
        .when(F.col("is_identical"), "IDENTICAL")
        .when(F.col("is_superset"), "SUPERSET")
        .when((F.col("n") < F.col("total_items")) | (F.col("total_items") > 1), "DIFFERENT")
        .otherwise("CONTENT_MATCH")
    )
    return rows.select("rel", F.coalesce("a_kind", "b_kind").alias("kind"), status.alias("status"))


def compare(analyzed: DataFrame, repository: DataFrame, start: str, against: str, rule: MatchRule = MatchRule()) -> DataFrame:
    """node_status() of two directories without a report. Only what stands at the same place below both counts for it, so
    that files meet on place and digest, and nothing outside the two directories is matched."""

    def inside(catalog: DataFrame, top: str) -> DataFrame:
        kept = catalog.where((F.col("path") == top) | F.col("path").startswith(top + "/"))
        return kept.withColumn("rel", F.substring("path", F.lit(len(top) + 2), F.length("path")))

    a, b = inside(analyzed, start), inside(repository, against)
    files = analyze.file_matches(a, b, rule, ("digest", "rel")).persist()
    dirs = analyze.dir_matches(a, b, files, rule)
    totals = analyze.dir_totals(a, files).select("path", "total_items").unionByName(a.where("kind = 'file'").select("path", F.lit(1).cast("long").alias("total_items")))
    return node_status(analyzed, repository, files.unionByName(dirs), totals, start, against)


def diff_tree(nodes: DataFrame, hide_content_match: bool = False, max_depth: int | None = 3, show: str = "both") -> DataFrame:
    """rel, kind, status, depth, cut of the nodes that print. nodes: from node_status. cut: the depth ends here.

    Nodes go with all below them if they are identical, hidden, of the side that is not shown, or neither file nor
    directory. Files print, and directories at the greatest depth; other directories print if something below does.
    """
    nodes = nodes.persist()  # used for what blocks, what is under it and what prints
    hidden = (F.col("status") == "IDENTICAL") | ~F.col("kind").isin("file", "dir")
    if hide_content_match:
        hidden = hidden | (F.col("status") == "CONTENT_MATCH")
    if show == "analyzed":
        hidden = hidden | (F.col("status") == "REPOSITORY_ONLY")
    if show == "repository":
        hidden = hidden | (F.col("status") == "ANALYZED_ONLY")
    p = parts(F.col("rel"))
    rows = nodes.where("rel <> ''").withColumn("depth", F.size(p))
    if max_depth is not None:
        rows = rows.where(F.col("depth") <= max(max_depth, 1))
    blocked = rows.where(hidden | (F.col("kind") != "dir")).select(F.col("rel").alias("up"))
    under = rows.select("rel", F.explode(ancestors(p)).alias("up")).join(blocked, "up").select("rel").distinct()
    live = rows.where(~hidden).join(under, "rel", "left_anti")
    cut = (F.col("kind") == "dir") & (F.lit(False) if max_depth is None else F.col("depth") >= max(max_depth, 1))
    live = live.withColumn("cut", cut)
    printing = live.where((F.col("kind") == "file") | F.col("cut"))
    seen = printing.select(F.explode(prefixes(p)).alias("rel")).distinct()
    return live.join(seen, "rel", "left_semi").select("rel", "kind", "status", "depth", "cut")


def render(rows: list[dict], start: str, status: str = "DIFFERENT") -> str:
    """The tree as text, from collected rows of diff_tree."""
    if not rows:
        return "Directories are identical."
    below: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["rel"].split("/")):
        below.setdefault(r["rel"].rpartition("/")[0], []).append(r)
    lines = [start.rpartition("/")[2] + MARKS[status]]

    todo = [("", "", iter(below.get("", [])), len(below.get("", [])))]  # (directory, lead, its entries to come, how many)
    while todo:
        at, lead, entries, left = todo.pop()
        r = next(entries, None)
        if r is None:
            continue
        todo.append((at, lead, entries, left - 1))
        lines.append(lead + ("└── " if left == 1 else "├── ") + r["rel"].rpartition("/")[2] + MARKS[r["status"]])
        deeper = lead + ("    " if left == 1 else "│   ")
        if r["cut"]:
            lines.append(deeper + "└── ...")
        elif r["kind"] == "dir":
            own = below.get(r["rel"], [])
            todo.append((r["rel"], deeper, iter(own), len(own)))
    return "\n".join(lines)
