"""Quality rules with thresholds that follow each language and source. DataFrame functions only.

Every document's measures are computed in one pass. Per (lang, source) a KLL quantile sketch of each ratio is built
with map-side partial sketches; sketches are mergeable, so those of a language and of all documents are merged from
them. A ratio is too high if it lies above median + SPREADS * (upper quartile - median) + the measure's least spread,
with quantiles of the document's own (lang, source) if that has at least MIN_GROUP documents, else of its language,
else of all. Documents meet their cutoffs in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, free_name, if_small, made, settled, stored, text_key, words_of

#: Items a sketch keeps at its lowest level; rank error about 0.1 %, exact for groups up to this size.
SKETCH_K = 2048
#: Groups with fewer documents take the cutoffs of their language or of all documents.
MIN_GROUP = 50
SPREADS = 4.0
#: Measures a cutoff is set for, as ratios, each with the least distance of the cutoff above the median.
RATIOS = {
    "symbols_per_word": 0.15,
    "dup_line_share": 0.25,
    "upper_share": 0.25,
    "word_length": 2.0,
}


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_lines added.

    Windows are found by xxhash64 of five words' hashes. Texts without a repeated window, nearly all, take a hash set
    of them; in others the sorted (hash, place) pairs give the repeated places. Work is n log n in a text's words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words_of(F.col(text)))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = (
        out.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn("n_upper", F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_words", "_lines")
    )
    out = out.withColumn("_windows", F.when(F.size("_hashes") >= 5, F.transform(F.sequence(F.lit(1), F.size("_hashes") - 4), lambda i: F.xxhash64(F.slice("_hashes", i, 5))))).drop("_hashes")
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    out = out.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    near = lambda x, i, by: F.get("_sorted", i + by)["h"].eqNullSafe(x["h"])
    twice = F.filter("_sorted", lambda x, i: near(x, i, -1) | near(x, i, 1))
    out = out.withColumn("_places", F.when(F.col("_sorted").isNotNull(), F.array_sort(F.transform(twice, lambda x: x["i"])))).drop("_sorted")
    gaps = F.transform("_places", lambda x, i: F.when(i == 0, F.lit(5)).otherwise(F.least(F.lit(5), x - F.get("_places", i - 1))))
    return out.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _ratio(name: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "word_length": F.col("word_chars") / words,
    }[name]


def _cutoff(sketch: str, least: float) -> Column:
    median, upper = (F.expr(f"kll_sketch_get_quantile_double({sketch}, {q}D)") for q in (0.5, 0.75))
    return median + SPREADS * (upper - median) + least


def cutoffs(measured: DataFrame) -> DataFrame:
    """One row per (lang, source): n and a cutoff per ratio, after the fall back for small groups.

    A level's sketches are merged from those of the level below, with one row per group.
    """
    sketch = lambda r: F.expr(f"kll_sketch_agg_double({r}, {SKETCH_K})").alias(r)
    merged = lambda r: F.expr(f"kll_merge_agg_double({r}, {SKETCH_K})").alias(r)
    n = F.count(F.lit(1)).cast("long").alias("n")
    fine = measured.select("lang", "source", *[_ratio(r).alias(r) for r in RATIOS]).groupBy("lang", "source").agg(n, *[sketch(r) for r in RATIOS])
    fine = stored(fine, "sketches")
    per_lang = fine.groupBy("lang").agg(F.sum("n").alias("n"), *[merged(r) for r in RATIOS])
    whole = fine.agg(F.sum("n").alias("n"), *[merged(r) for r in RATIOS])
    named = lambda df, level, keys: df.select(*keys, F.col("n").alias(f"n_{level}"), *[_cutoff(r, least).alias(f"{level}_{r}") for r, least in RATIOS.items()])
    a, b, c = named(fine, "own", ["lang", "source"]), named(per_lang, "lang", [F.col("lang").alias("lang_")]), named(whole, "all", [])
    out = a.join(b, a["lang"].eqNullSafe(b["lang_"])).join(c, F.lit(True))  # c is one row
    pick = lambda r: F.when(F.col("n_own") >= MIN_GROUP, F.col(f"own_{r}")).when(F.col("n_lang") >= MIN_GROUP, F.col(f"lang_{r}")).otherwise(F.col(f"all_{r}"))
    return out.select("lang", "source", F.col("n_own").alias("n"), *[pick(r).alias(f"max_{r}") for r in RATIOS])


def judged(measured: DataFrame) -> DataFrame:
    """Adds base_failed and kept. Null lang or source is a group of its own."""
    limits = cutoffs(measured).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"max_{r}" for r in RATIOS])
    out = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")))
    fine = ~base_failed()
    for r in RATIOS:
        fine = fine & (_ratio(r) <= F.col(f"max_{r}"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", fine).drop("_lang", "_source", *[f"max_{r}" for r in RATIOS])


NARROW = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]


def quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each row of docs (doc_id, text, lang, source; other columns are ignored).

    Null and empty texts have no words and fail the base. An empty table gives an empty result; repeated rows are
    judged each, with the same verdict.
    """
    return judged(stored(measures(docs.select("doc_id", "text", "lang", "source")).select(*NARROW), "measures"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source) that pass, with all their columns, which may have any names.

    Null and empty texts fail; repeated rows pass or fail alike; an empty table stays empty. Rows of equal text, lang and
    source have one verdict, so that no table holds the texts again: those that fail are told by their text's digest.
    """
    since = made()
    held = docs.select(text_key("text").alias("_key"), "text", "lang", "source")
    narrow = stored(measures(held).drop("text"), "measured")
    failed = judged(narrow).where(~F.coalesce("kept", F.lit(False)))
    of, lang, source = (free_name(docs, c) for c in ("_of", "_lang", "_source"))
    gone = settled(failed.select(F.col("_key").alias(of), F.col("lang").alias(lang), F.col("source").alias(source)).distinct(), "failed", since)
    same = (text_key("text") == F.col(of)) & F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source))
    return docs.join(if_small(gone), same, "left_anti")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; nulls, empty and long texts, ties, repeated rows, other columns and an empty
    table as in quality()."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_upper", "n_lines")


_RATIO_SQL = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
}


def _levels(r: str, least: float) -> str:
    of = lambda over: f"quantile_disc({r}, 0.5) {over} + {SPREADS} * (quantile_disc({r}, 0.75) {over} - quantile_disc({r}, 0.5) {over}) + {least}"
    own, lang, whole = of("OVER (PARTITION BY lang, source)"), of("OVER (PARTITION BY lang)"), of("OVER ()")
    return f"CASE WHEN n_own >= {MIN_GROUP} THEN {own} WHEN n_lang >= {MIN_GROUP} THEN {lang} ELSE {whole} END AS max_{r}"


OP5_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
p AS (SELECT rid, i, ws[i:i+4] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS k FROM p) WHERE k > 1),
g AS (SELECT rid, CAST(sum(least(5, coalesce(i - before, 5))) AS BIGINT) AS n_repeat_words
      FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM d) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN g ON w.rid = g.rid),
r AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in _RATIO_SQL.items())},
             count(*) OVER (PARTITION BY lang, source) AS n_own, count(*) OVER (PARTITION BY lang) AS n_lang FROM m),
c AS (SELECT *, {", ".join(_levels(k, v) for k, v in RATIOS.items())} FROM r),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(f"{k} <= max_{k}" for k in RATIOS)}) AS kept, n_upper, n_lines FROM b
"""
assert SPACES == r"[\x20\x09-\x0D]+"  # the SQL above spells it out
