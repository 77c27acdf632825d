"""Queries over the driver's tables: documents as two trees of files, one indexed and one analysed.

Each query has DuckDB SQL beside it, written on its own, not derived from the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import metadata_diff
from ..functions.rule import FLAGS, MatchRule
from ..operators import analyze, describe, difftree, index
from ..sources.catalog import catalog_from_table, with_directories

ALL = MatchRule(True, True, True, True, True, True)


def doccat(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The analysed and the repository catalog: one file per path, with metadata from the least doc_id of the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    side = F.pmod("doc_id", F.lit(2))
    path = F.concat(F.when(side == 1, "docs/").otherwise(""), F.lit("k"), F.pmod("doc_id", F.lit(5)).cast("string"), F.lit("/"), F.col("lang"), F.lit("/g"), F.substring("digest", 1, 1), F.lit("/"), F.substring("digest", 1, 12), F.lit(".txt"))
    files = docs.groupBy(side.alias("side"), path.alias("path")).agg(F.min("doc_id").alias("id"), F.min("size").alias("size"), F.min("digest").alias("digest"))
    ns = lambda n: F.pmod("id", F.lit(n)) * 1_000_000_000
    null = lambda t: F.lit(None).cast(t)
    rows = files.select(
        F.when(F.col("side") == 1, "analyzed").otherwise("repository").alias("root"),
        "path",
        F.lit("file").alias("kind"),
        "size",
        ns(3).alias("mtime_ns"),
        ns(4).alias("atime_ns"),
        ns(5).alias("ctime_ns"),
        F.when(F.pmod("id", F.lit(7)) == 0, 33152).otherwise(33188).cast("long").alias("mode"),
        (1000 + F.pmod(F.floor(F.col("id") / 2), F.lit(2))).cast("long").alias("uid"),
        F.lit(100).cast("long").alias("gid"),
        null("string").alias("link_target"),
        null("int").alias("rdev_major"),
        null("int").alias("rdev_minor"),
        "digest",
    )
    tree = with_directories(rows)
    return tree.where("root = 'analyzed'"), tree.where("root = 'repository'")


_SQL = """
WITH d AS (SELECT doc_id, lang, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM documents),
f AS (SELECT doc_id % 2 AS side, (CASE WHEN doc_id % 2 = 1 THEN 'docs/' ELSE '' END) || 'k' || (doc_id % 5) || '/' || lang || '/g' || substr(digest, 1, 1) || '/' || substr(digest, 1, 12) || '.txt' AS path,
             min(doc_id) AS id, min(size) AS size, min(digest) AS digest FROM d GROUP BY ALL),
files AS (SELECT side, path, 'file' AS kind, size, (id % 3) * 1000000000 AS mtime_ns, (id % 4) * 1000000000 AS atime_ns, (id % 5) * 1000000000 AS ctime_ns,
             CASE WHEN id % 7 = 0 THEN 33152 ELSE 33188 END AS mode, 1000 + (id // 2) % 2 AS uid, 100 AS gid, digest, string_split(path, '/') AS p FROM f),
ks AS (SELECT unnest(range(1, 9)) AS k),
nodes AS (SELECT side, path, kind, size, mtime_ns, atime_ns, ctime_ns, mode, uid, gid, digest, p FROM files
          UNION ALL SELECT *, string_split(path, '/') FROM (SELECT DISTINCT side, array_to_string(p[1:k], '/') AS path, 'dir', 0, 0, 0, 0, 16877, 1000, 100, NULL FROM files, ks WHERE k < len(p))),
a AS (SELECT * FROM nodes WHERE side = 1), r AS (SELECT * FROM nodes WHERE side = 0)"""

_FLAGS = "a.mtime_ns = r.mtime_ns AS mtime_match, a.atime_ns = r.atime_ns AS atime_match, a.ctime_ns = r.ctime_ns AS ctime_match, a.mode = r.mode AS mode_match, a.uid = r.uid AS owner_match, a.gid = r.gid AS group_match"
_DEFAULT = "mtime_match AND mode_match AND owner_match AND group_match"
_EVERY = "mtime_match AND atime_match AND ctime_match AND mode_match AND owner_match AND group_match"
_FM = f""",
fp AS (SELECT a.path, r.path AS dup_path, {_FLAGS}, a.size AS duplicated_size, CAST(1 AS BIGINT) AS duplicated_items, a.p AS ap, r.p AS rp
       FROM a JOIN r ON a.digest = r.digest AND a.kind = 'file' AND r.kind = 'file'),
fm AS (SELECT path, dup_path, {", ".join(FLAGS)}, duplicated_size, duplicated_items, ({_DEFAULT}) AS is_identical, ({_DEFAULT}) AS is_superset FROM fp)"""
_DM = f""",
up AS (SELECT array_to_string(ap[1:len(ap) - k], '/') AS d, array_to_string(rp[1:len(rp) - k], '/') AS e, fp.* FROM fp, ks WHERE k < len(ap) AND k < len(rp) AND ap[-k:] = rp[-k:]),
m AS (SELECT DISTINCT d, e FROM up),
ch AS (SELECT side, array_to_string(p[1:len(p) - 1], '/') AS dir, p[-1] AS name, path FROM nodes WHERE len(p) > 1),
known AS (SELECT path AS x, dup_path AS y FROM fp UNION SELECT d, e FROM m),
loc AS (SELECT d, e, count(*) AS n_d, count(cr.name) AS n_both, count(known.x) AS n_match
        FROM m JOIN ch ca ON ca.side = 1 AND ca.dir = d LEFT JOIN ch cr ON cr.side = 0 AND cr.dir = e AND cr.name = ca.name
        LEFT JOIN known ON known.x = d || '/' || ca.name AND known.y = e || '/' || ca.name GROUP BY d, e),
cnt AS (SELECT dir, count(*) AS n_e FROM ch WHERE side = 0 GROUP BY dir),
own AS (SELECT d, e, {_FLAGS}, n_both <> n_d OR n_e <> n_d OR n_match <> n_d AS ni, n_both <> n_d OR n_match <> n_d AS ns,
               string_split(d, '/') AS ap, string_split(e, '/') AS rp
        FROM loc JOIN cnt ON cnt.dir = e JOIN a ON a.path = d JOIN r ON r.path = e),
k0 AS (SELECT unnest(range(0, 9)) AS k),
contrib AS (SELECT d, e, {", ".join(FLAGS)}, duplicated_size AS s, duplicated_items AS i, false AS ni, false AS ns FROM up
            UNION ALL SELECT array_to_string(ap[1:len(ap) - k], '/'), array_to_string(rp[1:len(rp) - k], '/'), {", ".join(FLAGS)}, 0, 0, ni, ns
            FROM own, k0 WHERE k < len(ap) AND k < len(rp) AND (k = 0 OR ap[-k:] = rp[-k:])),
dm AS (SELECT d AS path, e AS dup_path, {", ".join(f"bool_and({x}) AS {x}" for x in FLAGS)}, CAST(sum(s) AS BIGINT) AS duplicated_size, CAST(sum(i) AS BIGINT) AS duplicated_items,
              bool_and({_DEFAULT} AND NOT ni) AS is_identical, bool_and({_DEFAULT} AND NOT ns) AS is_superset FROM contrib GROUP BY d, e)"""
_TOT = """,
tot AS (SELECT array_to_string(p[1:k], '/') AS path, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS total_items,
               CAST(sum(CASE WHEN path IN (SELECT path FROM fm) THEN size ELSE 0 END) AS BIGINT) AS duplicated_size,
               CAST(sum(CASE WHEN path IN (SELECT path FROM fm) THEN 1 ELSE 0 END) AS BIGINT) AS duplicated_items
        FROM files, ks WHERE side = 1 AND k < len(p) GROUP BY 1)"""
_ALLM = ",\nallm AS (SELECT * FROM fm UNION ALL SELECT * FROM dm), rk AS (SELECT *, CASE WHEN is_identical THEN 2 WHEN is_superset THEN 1 ELSE 0 END AS rank_ FROM allm)"
_REC = """,
cnts AS (SELECT path, count(*) AS n_duplicates FROM allm GROUP BY path),
rec AS (SELECT tot.*, n_duplicates FROM tot JOIN cnts USING (path)
        UNION ALL SELECT path, size, 1, size, 1, n_duplicates FROM files JOIN cnts USING (path) WHERE side = 1)"""

FLAT = ["path", "total_size", "total_items", "duplicated_size", "duplicated_items", "n_duplicates"]


class _Case:
    """The catalogs and what is derived from them, built as far as a query asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.a, self.r = (t.persist() for t in doccat(spark, sf_dir))

    @cached_property
    def special(self) -> tuple[DataFrame, DataFrame]:
        """The catalogs with a link, a pipe or a device beside some files, told by digits of the digest; link targets and
        device numbers agree on both sides for some and depend on the side for others."""

        def more(t: DataFrame) -> DataFrame:
            digit = lambda i: F.conv(F.substring("digest", i, 1), 16, 10).cast("int")
            side = (F.col("root") == "analyzed").cast("int")
            files = t.where("kind = 'file'").withColumn("own", F.when(digit(15) < 8, side).otherwise(0))
            kinds = [("symlink", ".lnk", digit(14) < 5), ("fifo", ".pipe", digit(14).between(5, 8)), ("blk", ".dev", digit(14).between(9, 12))]
            for kind, ending, met in kinds:
                rows = files.where(met).withColumns({"path": F.concat("path", F.lit(ending)), "kind": F.lit(kind), "size": F.lit(0).cast("long"), "digest": F.lit(None).cast("string")})
                rows = rows.withColumn("link_target", F.when(F.lit(kind == "symlink"), F.concat(F.lit("t"), F.col("own").cast("string"))))
                rows = rows.withColumns({"rdev_major": F.when(F.lit(kind == "blk"), F.lit(8)), "rdev_minor": F.when(F.lit(kind == "blk"), F.col("own"))})
                t = t.unionByName(rows.select(*t.columns))
            return t

        return more(self.a).persist(), more(self.r).persist()

    def files(self, rule: MatchRule = MatchRule()) -> DataFrame:
        return analyze.file_matches(self.a, self.r, rule)

    @cached_property
    def found(self) -> tuple[DataFrame, DataFrame]:
        return self.files(), analyze.dir_matches(self.a, self.r, analyze.same_name_matches(self.a, self.r))

    def dirs(self) -> DataFrame:
        return self.found[1]

    def matches(self) -> DataFrame:
        return self.found[0].unionByName(self.found[1])

    def listed(self) -> DataFrame:
        return analyze.records(self.a, self.r, *self.found, analyze.matched_files(self.a, self.r))

    def records(self) -> DataFrame:
        return self.listed().withColumn("n_duplicates", F.size("duplicates").cast("long")).select(*FLAT)

    def nodes(self) -> DataFrame:
        return difftree.compare(self.a, self.r, "docs/k1", "k1")

    def signed(self) -> DataFrame:
        return index.assign_ec(index.signatures(self.r)).select(*index.SIGNATURE)

    def weak(self) -> DataFrame:
        """Digests that collide: the size modulo 64; contents differ by their true digest."""
        rows = self.r.where("kind = 'file'").select("path", F.pmod("size", F.lit(64)).cast("string").alias("digest"), "mtime_ns", F.col("digest").alias("content"))
        return index.assign_ec(rows, None, "content")

    def later(self) -> DataFrame:
        """Another state of the repository's files: some are gone, some new, some touched, some set back."""
        files = self.r.where("kind = 'file'")
        digit = F.conv(F.substring("digest", 2, 1), 16, 10).cast("int")
        kept = files.where(digit >= 2).withColumn("mtime_ns", F.when(digit < 5, F.col("mtime_ns") + 7).when(digit < 7, F.col("mtime_ns") - 7).otherwise(F.col("mtime_ns")))
        fresh = self.a.where("kind = 'file'").where(digit < 3)
        return kept.unionByName(fresh)


def _children(sort: str, c: _Case) -> DataFrame:
    out = describe.describe_children(c.records(), c.a, "docs", sort)
    return out.select("path", "kind", "place", *FLAT[1:])


def _top(sort: str, c: _Case) -> DataFrame:
    return describe.describe_duplicates(c.matches(), sort, 2).select("path", "dup_path", "place", "duplicated_size", "duplicated_items")


def _tree(c: _Case, **options) -> DataFrame:
    return difftree.diff_tree(c.nodes(), **options)


def _diff(c: _Case) -> DataFrame:
    a, r = (t.where("kind = 'file'") for t in (c.a, c.r))
    pairs = a.alias("x").join(r.alias("y"), F.col("x.digest") == F.col("y.digest"))
    of = lambda t: F.struct(*[F.col(f"{t}.{k}") for k in ("kind", "atime_ns", "ctime_ns", "mtime_ns")])
    return metadata_diff(pairs.select(F.col("x.path").alias("path"), F.col("y.path").alias("dup_path"), of("x").alias("a"), of("y").alias("b")))


def _exact(table: str, keys: list[str], text: str, c: _Case) -> DataFrame:
    return _grouped(c.spark.read.parquet(f"{c.dir}/{table}.parquet"), keys, text)


def _grouped(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    ident = F.concat_ws("-", *[F.lpad(F.col(k).cast("string"), 12, "0") for k in keys])
    per = rows.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(ident)), "|").alias("ids"))
    return per.where("n > 1")


def _articles(c: _Case) -> DataFrame:
    """Pages with equal articles, whatever stands around them."""
    pages = c.spark.read.parquet(f"{c.dir}/pages.parquet").select("page_id", F.regexp_extract("html", "(?s)<article>.*</article>", 0).alias("article"))
    return _grouped(pages, ["page_id"], "article")


def _shapes(c: _Case) -> DataFrame:
    """Conversations with the same roles in turn."""
    turns = c.spark.read.parquet(f"{c.dir}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return _grouped(turns.select("conv_id", F.array_join("t.role", ",").alias("roles")), ["conv_id"], "roles")


def special_items(c: _Case) -> DataFrame:
    """Links, pipes and devices that are found at their place in a matched directory."""
    a, r = c.special
    pairs = analyze.directory_pairs(c.files())
    found = analyze.deferred_items(pairs, a, r, analyze.deferred_children(a, pairs)).where("items > 0")
    return found.select("d", "e", F.col("x").alias("path"), "mtime_match", "mode_match", "owner_match")


def special_totals(c: _Case) -> DataFrame:
    """Totals where links, pipes and devices are items too."""
    a, r = c.special
    files = c.files()
    pairs = analyze.directory_pairs(files).withColumnsRenamed({"d": "path", "e": "dup_path"})
    return analyze._with_special(analyze.dir_totals(a, files), a, r, pairs)


def _ancestor(c: _Case) -> DataFrame:
    source = index.assign_ec(index.signatures(c.a)).select(*index.SIGNATURE)
    return index.import_signatures(c.signed(), source, prefix_strip="docs")


def _nested(c: _Case) -> DataFrame:
    source = index.assign_ec(index.signatures(c.a)).select(*index.SIGNATURE)
    return index.import_signatures(c.signed(), source, prefix_add="nested/repo")


_ORDER = {
    "size": "duplicated_size DESC, rank_ DESC, length(dup_path)",
    "items": "duplicated_items DESC, rank_ DESC, length(dup_path)",
    "identical": "rank_ DESC, length(dup_path)",
    "path": "length(dup_path), rank_ DESC",
}
_CHILD_ORDER = {
    "dup-size": "coalesce(duplicated_size, 0) DESC, coalesce(n_duplicates, 0) DESC, coalesce(total_size, 0) DESC, ",
    "dup-items": "coalesce(n_duplicates, 0) DESC, coalesce(duplicated_size, 0) DESC, coalesce(total_size, 0) DESC, ",
    "total-size": "coalesce(total_size, 0) DESC, ",
    "name": "",
}
_NODES = """,
na AS (SELECT substr(path, 9) AS rel, path, kind, p FROM a WHERE path = 'docs/k1' OR starts_with(path, 'docs/k1/')),
nr AS (SELECT substr(path, 4) AS rel, path AS dup_path, kind FROM r WHERE path = 'k1' OR starts_with(path, 'k1/')),
nodes2 AS (SELECT coalesce(na.rel, nr.rel) AS rel, coalesce(na.kind, nr.kind) AS kind,
  CASE WHEN na.path IS NULL THEN 'REPOSITORY_ONLY' WHEN nr.dup_path IS NULL THEN 'ANALYZED_ONLY' WHEN x.path IS NULL THEN 'DIFFERENT'
       WHEN is_identical THEN 'IDENTICAL' WHEN is_superset THEN 'SUPERSET' WHEN x.duplicated_items < total_items OR total_items > 1 THEN 'DIFFERENT' ELSE 'CONTENT_MATCH' END AS status
  FROM na FULL JOIN nr ON na.rel = nr.rel LEFT JOIN allm x ON x.path = na.path AND x.dup_path = nr.dup_path LEFT JOIN rec ON rec.path = na.path)"""


def _tree_sql(hidden: str = "false", depth: int = 99) -> str:
    return (
        _SQL + _FM + _DM + _TOT + _ALLM + _REC + _NODES + f""",
t AS (SELECT *, string_split(rel, '/') AS q, (status = 'IDENTICAL' OR {hidden}) AS hid FROM nodes2 WHERE rel <> '' AND len(string_split(rel, '/')) <= {depth}),
live AS (SELECT *, (kind = 'dir' AND len(q) >= {depth}) AS cut FROM t WHERE NOT hid AND NOT EXISTS (SELECT 1 FROM t u WHERE (u.hid OR u.kind <> 'dir') AND starts_with(t.rel, u.rel || '/'))),
pr AS (SELECT rel FROM live WHERE kind = 'file' OR cut)
SELECT rel, kind, status, len(q) AS depth, cut FROM live WHERE EXISTS (SELECT 1 FROM pr WHERE pr.rel = live.rel OR starts_with(pr.rel, live.rel || '/'))"""
    )


_LATER = """,
sig AS (SELECT path, digest, mtime_ns, 0 AS ec_id FROM files WHERE side = 0),
hx AS (SELECT *, CAST(('0x' || substr(digest, 2, 1)) AS INTEGER) AS h FROM files),
later AS (SELECT path, digest, CASE WHEN h < 5 THEN mtime_ns + 7 WHEN h < 7 THEN mtime_ns - 7 ELSE mtime_ns END AS mtime_ns FROM hx WHERE side = 0 AND h >= 2
          UNION ALL SELECT path, digest, mtime_ns FROM hx WHERE side = 1 AND h < 3),
rp AS (SELECT coalesce(s.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'delete' WHEN s.path IS NULL THEN 'insert' WHEN s.mtime_ns < l.mtime_ns THEN 'update' ELSE 'keep' END AS action,
              s.digest AS old_digest, s.mtime_ns AS old_mtime_ns, s.ec_id AS old_ec_id, l.digest AS digest, l.mtime_ns AS new_mtime_ns FROM sig s FULL JOIN later l ON s.path = l.path)"""


_SPECIAL = """,
sf AS (SELECT *, CAST(('0x' || substr(digest, 14, 1)) AS INTEGER) AS h, CASE WHEN CAST(('0x' || substr(digest, 15, 1)) AS INTEGER) < 8 THEN side ELSE 0 END AS own FROM files),
sp AS (SELECT side, path || CASE WHEN h < 5 THEN '.lnk' WHEN h < 9 THEN '.pipe' ELSE '.dev' END AS path, CASE WHEN h < 5 THEN 'symlink' WHEN h < 9 THEN 'fifo' ELSE 'blk' END AS kind,
              CASE WHEN h BETWEEN 5 AND 8 THEN 0 ELSE own END AS told, mtime_ns, mode, uid, p FROM sf WHERE h < 13),
near AS (SELECT s.path, max(len(m.d)) AS n FROM (SELECT * FROM sp WHERE side = 1) s JOIN (SELECT DISTINCT d FROM m) m ON starts_with(s.path, m.d || '/') GROUP BY s.path),
met AS (SELECT m.d, m.e, a.path, a.mtime_ns = r.mtime_ns AS mtime_match, a.mode = r.mode AS mode_match, a.uid = r.uid AS owner_match
        FROM near JOIN sp a ON a.path = near.path AND a.side = 1 JOIN m ON m.d = substr(a.path, 1, n)
        JOIN sp r ON r.side = 0 AND r.path = m.e || substr(a.path, n + 1) AND r.kind = a.kind AND r.told = a.told)"""
_SPECIAL_TOTALS = """,
items AS (SELECT path, size, p, path IN (SELECT path FROM fm) AS hit FROM files WHERE side = 1 UNION ALL SELECT path, 0, p, false FROM sp WHERE side = 1),
more AS (SELECT array_to_string(string_split(d, '/')[1:k], '/') AS path, count(*) AS more FROM (SELECT DISTINCT d, path AS x FROM met), ks WHERE k <= len(string_split(d, '/')) GROUP BY 1),
st AS (SELECT array_to_string(p[1:k], '/') AS path, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS total_items, CAST(sum(CASE WHEN hit THEN size ELSE 0 END) AS BIGINT) AS duplicated_size,
              CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM items, ks WHERE k < len(p) GROUP BY 1)
SELECT path, total_size, total_items, duplicated_size, hits + coalesce(more, 0) AS duplicated_items FROM st LEFT JOIN more USING (path)"""


def _import_sql(path: str) -> str:
    return _SQL + f""",
moved AS (SELECT {path} AS path, digest, mtime_ns FROM files WHERE side = 1),
sig AS (SELECT path, digest, mtime_ns FROM files WHERE side = 0),
come AS (SELECT * FROM moved WHERE digest IN (SELECT digest FROM moved WHERE path NOT IN (SELECT path FROM sig)))
SELECT path, digest, mtime_ns, 0 AS ec_id FROM sig WHERE path NOT IN (SELECT path FROM come) UNION ALL SELECT path, digest, mtime_ns, 0 FROM come"""


def _exact_sql(table: str, keys: list[str], text: str) -> str:
    ident = " || '-' || ".join(f"lpad(CAST({k} AS VARCHAR), 12, '0')" for k in keys)
    return f"SELECT * FROM (SELECT sha256({text}) AS digest, count(*) AS n, string_agg({ident}, '|' ORDER BY {ident}) AS ids FROM {table} GROUP BY 1) WHERE n > 1"


_MATCH = ", ".join(analyze.MATCH_COLUMNS)
_FP_ALL = f"{_FM}\nSELECT path, dup_path, {', '.join(FLAGS)}, duplicated_size, duplicated_items, ({_EVERY}) AS is_identical, ({_EVERY}) AS is_superset FROM fp"
_EC = _SQL + ",\nec AS (SELECT digest, string_agg(path, '|' ORDER BY p) AS paths, count(*) AS n FROM files WHERE side = 0 GROUP BY digest)"
_WEAK = _SQL + """,
w AS (SELECT path, CAST(size % 64 AS VARCHAR) AS weak, digest, first_value(p) OVER (PARTITION BY size % 64, digest ORDER BY p) AS first_path FROM files WHERE side = 0)"""

#: name: (query, SQL)
TABLE: dict[str, tuple[Callable[[_Case], DataFrame], str]] = {
    "catalog": (lambda c: c.a.unionByName(c.r).select("root", "path", "kind", "size", "mtime_ns", "mode", "uid"), _SQL + " SELECT CASE WHEN side = 1 THEN 'analyzed' ELSE 'repository' END AS root, path, kind, size, mtime_ns, CAST(mode AS BIGINT) AS mode, uid FROM nodes"),
    "file_signatures": (lambda c: c.signed(), _SQL + " SELECT path, digest, mtime_ns, 0 AS ec_id FROM files WHERE side = 0"),
    "signature_lookup": (lambda c: c.signed().where(F.col("path").startswith("k1/en/")), _SQL + " SELECT path, digest, mtime_ns, 0 AS ec_id FROM files WHERE side = 0 AND starts_with(path, 'k1/en/')"),
    "signature_delete": (lambda c: index.deregister(c.signed(), c.signed().where(F.col("path").startswith("k2/")).select("path")), _SQL + " SELECT path, digest, mtime_ns, 0 AS ec_id FROM files WHERE side = 0 AND NOT starts_with(path, 'k2/')"),
    "ec_classes": (lambda c: index.ec_classes(c.signed()), _EC + " SELECT digest, 0 AS ec_id, paths, n FROM ec"),
    "ec_ids_weak_hash": (lambda c: c.weak().select("path", "digest", "ec_id"), _WEAK + " SELECT path, weak AS digest, CAST(dense_rank() OVER (PARTITION BY weak ORDER BY first_path) - 1 AS INTEGER) AS ec_id FROM w"),
    "duplicate_groups": (lambda c: index.duplicate_groups(c.signed()), _EC + " SELECT digest, 0 AS ec_id, paths, n FROM ec WHERE n > 1"),
    "file_matches": (lambda c: c.files(), _SQL + _FM + f" SELECT {_MATCH} FROM fm"),
    "file_matches_rule_default": (lambda c: c.files().where("is_identical").select("path", "dup_path"), _SQL + _FM + " SELECT path, dup_path FROM fm WHERE is_identical"),
    "file_matches_rule_all": (lambda c: c.files(ALL), _SQL + _FP_ALL),
    "unmatched_files": (lambda c: analyze.unmatched_files(c.a, c.r).select("path", "size"), _SQL + _FM + " SELECT path, size FROM files WHERE side = 1 AND path NOT IN (SELECT path FROM fm)"),
    "file_records": (lambda c: c.files().groupBy("path").agg(F.max("duplicated_size").alias("total_size"), F.count(F.lit(1)).alias("n_duplicates")), _SQL + _FM + " SELECT path, max(duplicated_size) AS total_size, count(*) AS n_duplicates FROM fm GROUP BY path"),
    "dir_pairs": (lambda c: analyze.directory_pairs(analyze.same_name_matches(c.a, c.r)), _SQL + _FM + _DM + " SELECT d, e FROM m"),
    "dir_matches": (lambda c: c.dirs().select("path", "dup_path", "duplicated_size", "duplicated_items"), _SQL + _FM + _DM + " SELECT path, dup_path, duplicated_size, duplicated_items FROM dm"),
    "dir_match_flags": (lambda c: c.dirs(), _SQL + _FM + _DM + f" SELECT {_MATCH} FROM dm"),
    "dir_totals": (lambda c: analyze.dir_totals(c.a, analyze.matched_files(c.a, c.r)), _SQL + _FM + _TOT + " SELECT * FROM tot"),
    "dir_records": (lambda c: c.records(), _SQL + _FM + _DM + _TOT + _ALLM + _REC + f" SELECT {', '.join(FLAT)} FROM rec"),
    **{f"describe_top_{s}": (partial(_top, s), _SQL + _FM + _DM + _ALLM + f" SELECT * FROM (SELECT path, dup_path, CAST(row_number() OVER (PARTITION BY path ORDER BY {o}, string_split(dup_path, '/')) AS INTEGER) AS place, duplicated_size, duplicated_items FROM rk) WHERE place <= 2") for s, o in _ORDER.items()},
    **{
        f"describe_children_{s.replace('-', '_')}": (
            partial(_children, s),
            _SQL + _FM + _DM + _TOT + _ALLM + _REC + f" SELECT a.path, kind, CAST(row_number() OVER (ORDER BY {o} a.p[-1]) AS INTEGER) AS place, total_size, total_items, duplicated_size, duplicated_items, n_duplicates FROM a LEFT JOIN rec ON rec.path = a.path WHERE len(a.p) = 2",
        )
        for s, o in _CHILD_ORDER.items()
    },
    "describe_best_match": (
        lambda c: describe.best_match(c.matches()),
        _SQL + _FM + _DM + _ALLM + f" SELECT path, dup_path AS best_path, duplicated_size AS best_size, rank_ AS best_rank, n_duplicates FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {_ORDER['size']}, string_split(dup_path, '/')) AS i, count(*) OVER (PARTITION BY path) AS n_duplicates FROM rk) WHERE i = 1",
    ),
    "difftree_status": (lambda c: c.nodes(), _SQL + _FM + _DM + _TOT + _ALLM + _REC + _NODES + " SELECT rel, kind, status FROM nodes2"),
    "difftree_all": (partial(_tree, max_depth=None), _tree_sql()),
    "difftree_show_analyzed": (partial(_tree, max_depth=None, show="analyzed"), _tree_sql("status = 'REPOSITORY_ONLY'")),
    "difftree_show_repository": (partial(_tree, max_depth=None, show="repository"), _tree_sql("status = 'ANALYZED_ONLY'")),
    "difftree_hide_content": (partial(_tree, max_depth=None, hide_content_match=True), _tree_sql("status = 'CONTENT_MATCH'")),
    "difftree_depth2": (partial(_tree, max_depth=2), _tree_sql(depth=2)),
    "difftree_depth3": (partial(_tree, max_depth=3), _tree_sql(depth=3)),
    "refresh_plan": (lambda c: index.refresh_plan(c.signed(), c.later()), _SQL + _LATER + " SELECT * FROM rp"),
    "refresh_apply": (lambda c: index.refresh_apply(c.signed(), c.later()), _SQL + _LATER + " SELECT path, CASE WHEN action = 'keep' THEN old_digest ELSE digest END AS digest, CASE WHEN action = 'keep' THEN old_mtime_ns ELSE new_mtime_ns END AS mtime_ns, 0 AS ec_id FROM rp WHERE action <> 'delete'"),
    "import_nested": (_nested, _import_sql("'nested/repo/' || path")),
    "import_ancestor": (_ancestor, _import_sql("substr(path, 6)")),
    "inspect_lines": (
        lambda c: index.inspect_lines(c.signed(), {"hash-algorithm": "sha256"}),
        _SQL + " SELECT 'manifest-property hash-algorithm sha256' AS line UNION ALL SELECT 'file-hash ' || digest || ' ec_id:0 ' || path FROM files WHERE side = 0 UNION ALL SELECT 'file-metadata ' || path || ' digest:' || digest || ' mtime:' || strftime(make_timestamp(mtime_ns // 1000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z ec_id:0' FROM files WHERE side = 0",
    ),
    "metadata_diff": (_diff, _SQL + " SELECT path, dup_path, t AS type, x AS a_ns, y AS b_ns FROM (" + " UNION ALL ".join(f"SELECT a.path, r.path AS dup_path, '{t}' AS t, a.{t}_ns AS x, r.{t}_ns AS y FROM a JOIN r ON a.digest = r.digest" for t in ("atime", "ctime", "mtime")) + ") WHERE x <> y"),
    "describe_rows": (
        lambda c: describe.describe_rows(c.a.select("path", "kind"), c.listed()).select("path", "kind", "in_report", "best_size", "best_rank", "size_ratio", "items_ratio", "max_ratio"),
        _SQL + _FM + _DM + _TOT + _ALLM + _REC + f""",
bm AS (SELECT * FROM (SELECT path, duplicated_size AS best_size, rank_ AS best_rank, row_number() OVER (PARTITION BY path ORDER BY {_ORDER["size"]}, string_split(dup_path, '/')) AS i FROM rk) WHERE i = 1)
SELECT a.path, kind, rec.path IS NOT NULL AS in_report, best_size, best_rank, CASE WHEN total_size > 0 THEN duplicated_size / total_size ELSE 0.0 END AS size_ratio,
       CASE WHEN total_items > 0 THEN duplicated_items / total_items ELSE 0.0 END AS items_ratio, CASE WHEN total_size > 0 THEN best_size / total_size ELSE 0.0 END AS max_ratio
FROM a LEFT JOIN rec ON rec.path = a.path LEFT JOIN bm ON bm.path = a.path""",
    ),
    "special_items": (special_items, _SQL + _FM + _DM + _SPECIAL + " SELECT d, e, path, mtime_match, mode_match, owner_match FROM met"),
    "special_totals": (special_totals, _SQL + _FM + _DM + _SPECIAL + _SPECIAL_TOTALS),
    "pages_article_dup": (_articles, "SELECT * FROM (SELECT sha256(x) AS digest, count(*) AS n, string_agg(i, '|' ORDER BY i) AS ids FROM (SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS i, regexp_extract(html, '(?s)<article>.*</article>') AS x FROM pages) GROUP BY 1) WHERE n > 1"),
    "conversations_shape_dup": (_shapes, "SELECT * FROM (SELECT sha256(x) AS digest, count(*) AS n, string_agg(i, '|' ORDER BY i) AS ids FROM (SELECT lpad(CAST(conv_id AS VARCHAR), 12, '0') AS i, string_agg(role, ',' ORDER BY turn) AS x FROM conversations GROUP BY conv_id) GROUP BY 1) WHERE n > 1"),
    "pages_exact_dup": (partial(_exact, "pages", ["page_id"], "html"), _exact_sql("pages", ["page_id"], "html")),
    "conversations_exact_dup": (partial(_exact, "conversations", ["conv_id", "turn"], "text"), _exact_sql("conversations", ["conv_id", "turn"], "text")),
    "documents_exact_dup": (partial(_exact, "documents", ["doc_id"], "text"), _exact_sql("documents", ["doc_id"], "text")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(_Case(spark, sf_dir))) for name, (f, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in TABLE.items()}
