"""Mixing sources to target weights by entropy balancing.

The rates r of the documents minimise sum(size * (r * ln r - r + 1)), 0 <= r <= limit, under constraints on tokens: each
source's sum(size * r) equals its target, and the mix has tokens of short and long documents in the proportions of all
documents, the classes being powers of two. The first are met exactly; a class gives way by GIVE of its tokens for each
unit of its multiplier, so that there always is a solution, also where a class is found in one source alone. The dual is
convex; its rates are exponential tilts of the natural rate 1, r = min(limit, exp(multiplier of source + of class)).

Newton's steps run over the classes' multipliers, CLASSES of them whatever the input. Each step is one pass over the
sources: a source's own multiplier follows from those of the classes, by Newton's steps in one dimension, and sources add
up to the gradient and the Hessian of what is left. Only these sums go to the driver, no source and no document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import dense_slots, free_name, if_small, n_words_of, stored

#: Classes of document sizes: class k has sizes of 2 ** k - 1 and more.
CLASSES = 40
#: By how much of its tokens a class may miss its share for each unit of its multiplier.
GIVE = 0.25
#: Documents in one block of the rounding, about.
BLOCK = 8192


def targets(sources: DataFrame, weights: list[float], limit: float) -> DataFrame:
    """sources: (source, source_size, weight rank from 0). Adds target: all words are shared by weight; no source gets
    more than limit times its size, and what is above goes to the others by weight, until none is above.
    The level (words per unit of weight) rises until no further source meets its limit; each step is one aggregate.
    """
    table = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    table = table.withColumn("most", F.col("source_size") * float(limit))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        below = F.lit(True) if level is None else F.col("most") > F.col("weight") * F.lit(level)
        got = table.agg(
            F.sum(F.when(below, F.col("weight")).otherwise(0.0)).alias("w"),
            F.sum(F.when(below, 0.0).otherwise(F.col("most"))).alias("held"),
            F.sum(F.when(below, 0).otherwise(1)).alias("full"),
        ).first()
        if got["full"] == full or not got["w"]:
            break
        full, level = got["full"], (total - got["held"]) / got["w"]
    level = level if level is not None else 0.0
    return table.withColumn("target", F.least("most", F.col("weight") * F.lit(level))).drop("weight", "most", "rank")


def class_of(size: Column) -> Column:
    return F.least(F.floor(F.log2(size + F.lit(1.0))), F.lit(CLASSES - 1)).cast("int")


def own_multipliers(words: np.ndarray, target: np.ndarray, m: np.ndarray, limit: float) -> np.ndarray:
    """For each source the multiplier a with sum(words * min(limit, exp(a + m))) = target, which is below limit * words.
    Newton's steps on a convex increasing function, kept within bounds that close in."""
    low = np.log(np.maximum(target, 1e-300) / words.sum(1)) - m.max()
    high = np.full(len(words), math.log(limit)) - m.min()
    a = (low + high) / 2
    for _ in range(200):
        mass = words * np.minimum(limit, np.exp(np.minimum(a[:, None] + m, 60)))
        gap = mass.sum(1) - target
        if (np.abs(gap) <= 1e-12 * target).all():
            break
        low, high = np.where(gap < 0, a, low), np.where(gap > 0, a, high)
        slope = np.where(a[:, None] + m < math.log(limit), mass, 0).sum(1)
        step = a - gap / np.maximum(slope, 1e-300)
        a = np.where((step > low) & (step < high), step, (low + high) / 2)
    return a


def _rates(frame: pd.DataFrame, m: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, rates, whether a source has a multiplier) by source and class. Sources that are full, at limit times their
    words, have the limit as rate, and those without words 1."""
    words = np.array(frame["words"].tolist(), dtype=np.float64).reshape(-1, CLASSES)
    target, size = frame["target"].to_numpy(np.float64), words.sum(1)
    tilted = (size > 0) & (target < limit * size * (1 - 1e-9)) & (target > 0)
    rates = np.where(size > 0, np.where(target > 0, limit, 0.0), 1.0)[:, None] * np.ones((1, CLASSES))
    if tilted.any():
        a = own_multipliers(words[tilted], target[tilted], m, limit)
        rates[tilted] = np.minimum(limit, np.exp(np.minimum(a[:, None] + m, 60)))
    return words, rates, tilted


def _sums(m: np.ndarray, limit: float):
    """One row for each partition: the dual's value, gradient and Hessian over the classes, of its sources."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value, gradient, hessian = 0.0, np.zeros(CLASSES), np.zeros((CLASSES, CLASSES))
        for frame in frames:
            if not len(frame):
                continue
            words, rates, tilted = _rates(frame, m, limit)
            mass = words * rates
            gradient += mass.sum(0)
            value += float((mass[~tilted] @ m).sum())
            w, r, target = words[tilted], rates[tilted], frame["target"].to_numpy(np.float64)[tilted]
            a = own_multipliers(w, target, m, limit)
            at = a[:, None] + m
            value += float((w * np.where(at < math.log(limit), r, limit + limit * (at - math.log(limit)))).sum() - target @ a)
            free = np.where(at < math.log(limit), w * r, 0)
            hessian += np.diag(free.sum(0)) - (free / np.maximum(free.sum(1), 1e-300)[:, None]).T @ free
        yield pd.DataFrame({"value": [value], "gradient": [gradient.tolist()], "hessian": [hessian.ravel().tolist()]})

    return run


def balance(alike: DataFrame, wanted: DataFrame, limit: float, give: float = GIVE, tolerance: float = 1e-7, steps: int = 100) -> DataFrame:
    """Distributed Newton iterations on the dual: (source, rates), a rate for each class of sizes. alike: (source, size, n),
    n rows of that size; wanted: (source, target). It raises if `steps` steps do not solve the dual."""
    cells = alike.groupBy("source", class_of(F.col("size")).alias("class")).agg(F.sum(F.col("size") * F.col("n")).cast("double").alias("w"))
    of = cells.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("of"))  # CLASSES at most
    words = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda k: F.coalesce(F.try_element_at("of", k), F.lit(0.0)))
    named = wanted.select(F.col("source").alias("_source"), "target")
    sources = stored(of.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("source", "target", words.alias("words")), "dual")
    totals = sources.agg(F.sum("target").alias("target"), *[F.sum(F.col("words")[k]).alias(f"w{k}") for k in range(CLASSES)]).first()
    share = np.array([totals[f"w{k}"] or 0.0 for k in range(CLASSES)])
    goal = share / max(share.sum(), 1.0) * (totals["target"] or 0.0)
    used = goal > 0

    def at(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rows = sources.mapInPandas(_sums(m, limit), "value double, gradient array<double>, hessian array<double>").collect()  # a row a task
        value = math.fsum(r["value"] for r in rows) - goal @ m + give / 2 * (goal @ m**2)
        gradient = sum((np.array(r["gradient"]) for r in rows), np.zeros(CLASSES)) - goal + give * goal * m
        hessian = sum((np.array(r["hessian"]).reshape(CLASSES, CLASSES) for r in rows), np.zeros((CLASSES, CLASSES))) + give * np.diag(goal)
        return value, gradient, hessian

    m = np.zeros(CLASSES)
    value, gradient, hessian = at(m)
    for _ in range(steps):
        if np.abs(gradient[used]).sum() <= tolerance * goal.sum():
            break
        step = np.zeros(CLASSES)
        step[used] = np.linalg.solve(hessian[np.ix_(used, used)], gradient[used])
        length = 1.0
        while True:
            tried = at(m - length * step)
            if tried[0] <= value - 1e-4 * length * (gradient @ step) or length < 1e-6:
                break
            length /= 2
        m, (value, gradient, hessian) = m - length * step, tried
    else:
        raise RuntimeError(f"the dual is not solved after {steps} steps")

    def rated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"source": frame["source"], "rates": _rates(frame, m, limit)[1].tolist()})

    return sources.mapInPandas(rated, f"source {dict(sources.dtypes)['source']}, rates array<double>")


def _round_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable")
    lows, mores, owed = [], [], 0.0
    for size, rate, n in zip(rows["size"].tolist(), rows["rate"].tolist(), rows["n"].tolist()):
        low = int(rate + 1e-9)
        owed += n * size * (rate - low)
        more = min(n, max(0, math.ceil(owed / size - 0.5))) if size > 0 and rate - low > 1e-9 else 0
        owed -= more * size
        lows.append(low)
        mores.append(more)
    return rows.assign(low=lows, more=mores).drop(columns=["tie", "block"])


def _round(table: DataFrame) -> DataFrame:
    """table: (doc_id, size, source, n, rate, block, ...). Adds low, the floor of the rate, and more, how many of the n
    rows are taken once more.

    Each block goes from its largest documents to its smallest and carries the words still owed, so that what is owed
    at the end is about a small document. A block holds some BLOCK documents of one source, however large that is.
    """
    table = table.withColumn("tie", F.xxhash64("doc_id", "size"))
    kept = [f for f in table.schema.fields if f.name not in ("tie", "block")]
    return table.groupBy("source", "block").applyInPandas(_round_block, StructType([*kept, StructField("low", LongType()), StructField("more", LongType())]))


def planned(docs: DataFrame, weights: list[float], limit: float = 3.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, source, size, n, source_size, target, rate, low, more: of the n rows of docs that agree in the first three,
    `more` are taken low + 1 times and the others low times. Null text has size 0."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words_of(F.col(text)).alias("size"))
    alike = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = stored(per.withColumn("all", F.lit(0)).withColumn("last", F.col("source").isNull()), "sources")
    ranked = dense_slots(per, "all", ["last", "source"], "rank").drop("all", "last")
    wanted = stored(targets(ranked, weights, limit), "targets")
    rates = balance(alike.select("source", "size", "n"), wanted.select("source", "target"), limit)
    table = wanted.join(rates.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_source", F.col("source")).drop("source")
    every = alike.join(if_small(stored(table, "rates")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    blocks = F.ceil(F.col("n_docs") / F.lit(BLOCK))
    rated = every.withColumn("rate", F.element_at("rates", class_of(F.col("size")) + 1)).withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), blocks))
    return _round(rated.drop("n_docs", "rates"))


#: Rows that one step of turns() makes.
TURNS = 4096


def turns(rows: DataFrame, n: str, turn: str) -> DataFrame:
    """Each row n times, with turn from 1 to n; in steps, so that no row holds a list as long as n."""
    step = free_name(rows, "_step")
    steps = rows.withColumn(step, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / TURNS).cast("long"))))
    return steps.withColumn(turn, F.explode(F.sequence(F.col(step) * TURNS + 1, F.least(F.col(n).cast("long"), (F.col(step) + 1) * TURNS)))).drop(step)


def mix(docs: DataFrame, weights: list[float], limit: float = 3.0, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Rates and copies per document.

    Returns doc_id, source, size, source_size, target, rate, copies, one row per row of docs. Null text has size 0 and
    is taken floor(rate) times; null source is a source of its own, the last. Repeated rows are documents of their own.
    An empty table gives an empty result. Extra columns are ignored. Equal input gives equal copies: rounding is by
    position in an order of size and hash, not by chance.
    """
    each = turns(planned(docs, weights, limit, text, source, doc_id), "n", "turn")
    copies = F.col("low") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)
    return each.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: list[float], limit: float = 3.0) -> DataFrame:
    """The mix itself: the rows of docs (doc_id, text, source), with all their columns, each as often as it is taken.

    Copies are found for (doc_id, source, size). Rows that agree in all three have one of two numbers of copies; they
    are numbered in an order of their text, and the first ones take the larger. Nulls, repeated rows and an empty table
    are as in mix(); other columns may have any names.
    """
    size, low, more, n, row, group = (free_name(docs, c) for c in ("_size", "_low", "_more", "_n", "_row", "_group"))
    ids = ["doc_id", "source", "size"]
    of = {c: free_name(docs, f"_of_{c}") for c in ids}
    plan = stored(planned(docs, weights, limit).where("low > 0 or more > 0"), "plan")
    plan = if_small(plan.select(*[F.col(c).alias(of[c]) for c in ids], F.col("low").alias(low), F.col("more").alias(more), F.col("n").alias(n)))
    left = docs.withColumn(size, n_words_of(F.col("text")))
    on = F.col("doc_id").eqNullSafe(F.col(of["doc_id"])) & F.col("source").eqNullSafe(F.col(of["source"])) & (F.col(size) == F.col(of["size"]))
    joined = left.join(plan, on)
    parted = (F.col(more) > 0) & (F.col(more) < F.col(n))
    taken = joined.where(~parted).withColumn(row, F.col(low) + (F.col(more) > 0).cast("long")).select(*docs.columns, row)
    if not plan.where(parted).isEmpty():
        some = joined.where(parted).withColumn(group, F.to_json(F.struct("doc_id", "source", size)))
        numbered = dense_slots(stored(some, "parted"), group, ["text"], row)
        taken = taken.unionByName(numbered.withColumn(row, F.col(low) + (F.col(row) < F.col(more)).cast("long")).select(*docs.columns, row))
    return turns(taken.where(F.col(row) > 0), row, size).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; nulls, empty texts, ties, repeated rows, other columns and an empty table as in mix()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, weights=[5.0, 2.0, 1.0], limit=3.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
