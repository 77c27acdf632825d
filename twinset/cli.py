"""Command line: rebuild, refresh, import, analyze, describe, diff-tree, inspect."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.paths import base_name, parent, parts
from .functions.rule import MatchRule
from .operators import analyze, describe, difftree
from .operators.repository import LOG, REPORT, Repository, find_report, find_repository, read_report, report_is_valid
from .sources.filesystem import catalog_from_fs

VARIABLE = "TWINSET_REPOSITORY"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinset", description=__doc__)
    p.add_argument("--repository", help=f"directory with the index; default: ${VARIABLE}, else the nearest above here")
    p.add_argument("--verbose", action="store_true", help="say what is being done")
    p.add_argument("--log-file", help="default: logging.path of the index's settings, else none")
    p.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), default="INFO")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("rebuild", "refresh", "inspect"):
        commands.add_parser(name)
    commands.add_parser("import").add_argument("source")
    a = commands.add_parser("analyze")
    a.add_argument("paths", nargs="+")
    a.add_argument("--compare-atime", action="store_true")
    a.add_argument("--compare-ctime", action="store_true")
    a.add_argument("--no-compare-owner", action="store_true")
    a.add_argument("--no-compare-group", action="store_true")
    d = commands.add_parser("describe")
    d.add_argument("paths", nargs="+")
    d.add_argument("--all", action="store_true")
    d.add_argument("--limit", type=int)
    d.add_argument("--details", action="store_true")
    d.add_argument("--bytes", action="store_true")
    d.add_argument("--sort-by", choices=describe.SORTS, default="size")
    d.add_argument("--sort-children", choices=describe.CHILD_SORTS, default="dup-size")
    d.add_argument("--directory", action="store_true")
    d.add_argument("--keep-input-order", action="store_true", help="several paths: as given, not sorted")
    t = commands.add_parser("diff-tree")
    t.add_argument("analyzed")
    t.add_argument("repository_directory")
    t.add_argument("--hide-content-match", action="store_true")
    t.add_argument("--max-depth", type=int, default=3)
    t.add_argument("--unlimited", action="store_true")
    t.add_argument("--show", choices=("both", "analyzed", "repository"), default="both")
    return p


def rule_of(args: argparse.Namespace) -> MatchRule:
    """Modification time and mode always count."""
    return MatchRule(include_atime=args.compare_atime, include_ctime=args.compare_ctime, include_owner=not args.no_compare_owner, include_group=not args.no_compare_group)


def limit_of(args: argparse.Namespace) -> int | None:
    if args.all:
        return None
    return args.limit if args.limit is not None else None if args.details else 1


def _repository(spark: SparkSession, args: argparse.Namespace) -> Repository:
    """rebuild and refresh make an index where there is none."""
    create = args.command in ("rebuild", "refresh")
    listen = (lambda m: print(m, file=sys.stderr)) if args.verbose else None
    given = args.repository or os.environ.get(VARIABLE)
    if not given:
        found = find_repository(os.getcwd())
        given = found[0] if found else os.getcwd()
    repository = Repository(spark, given, create, listen=listen)
    where = args.log_file or repository.settings.get("logging.path")
    if where:
        handler = logging.FileHandler(os.path.join(given, where) if not args.log_file else where)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        LOG.addHandler(handler)
        LOG.setLevel(args.log_level if args.log_file else repository.settings.get("logging.level", args.log_level))
    return repository


def _describe(spark: SparkSession, args: argparse.Namespace) -> str:
    found = [find_report(p) for p in args.paths]
    if None in found or len({f[0] for f in found}) != 1:
        raise SystemExit("all paths must belong to one report")
    if args.directory and (len(args.paths) != 1 or not os.path.isdir(args.paths[0])):
        raise SystemExit("--directory takes one directory")
    if args.keep_input_order and len(args.paths) < 2:
        raise SystemExit("--keep-input-order is for several paths")
    target = found[0][0]
    rows, manifest = read_report(spark, target)
    out = []
    if args.details:
        out += [f"Report: {target}{REPORT}", f"Analyzed: {target}", f"Repository: {manifest['repository_path']}", f"Timestamp: {manifest['timestamp']}", ""]
    tree = catalog_from_fs(spark, target, "analyzed", yield_root=True, digests=False)
    if len(args.paths) > 1:
        order = {f[1]: i for i, f in reversed(list(enumerate(found)))}
        named = tree.select("path", base_name(parts(F.col("path"))).alias("name"), "kind").where(F.col("path").isin(list(order)))
        listed = [r.asDict() for r in describe.describe_rows(named, rows).collect()]  # the given paths
        by = (lambda r: order[r["path"]]) if args.keep_input_order else describe.child_key(args.sort_children)
        return "\n".join([*out, describe.print_table([describe.describe_cells(r, args.bytes) for r in sorted(listed, key=by)], describe.TABLE)])
    path = found[0][1]
    record = rows.where(F.col("path") == path).first()
    folder = os.path.isdir(args.paths[0])
    if record is None:  # a directory without a match may hold entries that have one
        out.append(f"no duplicates: {path}")
    else:
        out += [describe.DEFINITIONS, ""] if args.details else []
        out.append(describe.print_duplicates(record.asDict(recursive=True), folder, args.sort_by, limit_of(args), args.bytes))
    if folder and not args.directory:
        p = parts(F.col("path"))
        named = tree.where(parent(p) == path).select("path", base_name(p).alias("name"), "kind")
        listed = [r.asDict() for r in describe.describe_rows(named, rows).collect()]  # one directory's entries
        out += ["", describe.print_table([describe.describe_cells(r, args.bytes) for r in sorted(listed, key=describe.child_key(args.sort_children))], describe.TABLE)]
    return "\n".join(out)


def _diff_tree(spark: SparkSession, args: argparse.Namespace) -> str:
    report, place = find_report(args.analyzed), find_repository(args.repository_directory)
    if not report or not place:
        raise SystemExit("there is no report above the analysed directory, or no repository above the other")
    repository = Repository(spark, place[0])
    if not report_is_valid(report[0], repository):
        raise SystemExit("the report was made with another repository")
    rows, _ = read_report(spark, report[0])
    matches = analyze.matches_of(rows)
    start = matches.where(F.col("path") == report[1])
    if start.where(F.col("dup_path") == place[1]).isEmpty():
        raise SystemExit("not a duplicate; these are: " + ", ".join(sorted(r["dup_path"] for r in start.select("dup_path").collect())))
    tree = catalog_from_fs(spark, report[0], "analyzed", yield_root=True, digests=False)
    nodes = difftree.node_status(tree, repository.catalog(digests=False), matches, rows, report[1], place[1])
    own = nodes.where("rel = ''").first()["status"]
    shown = difftree.diff_tree(nodes, args.hide_content_match, None if args.unlimited else args.max_depth, args.show)
    return difftree.render([r.asDict() for r in shown.collect()], report[1], own)  # what is printed


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("twinset").getOrCreate()
    if args.command == "describe":
        print(_describe(spark, args))
    elif args.command == "diff-tree":
        print(_diff_tree(spark, args))
    else:
        repository = _repository(spark, args)
        if args.command == "analyze":
            print("\n".join(repository.analyze(args.paths, rule_of(args))))
        elif args.command == "inspect":
            for line in repository.inspect():
                print(line)
        elif args.command == "import":
            repository.import_index(args.source)
        else:
            getattr(repository, args.command)()
    return 0


if __name__ == "__main__":
    sys.exit(main())
