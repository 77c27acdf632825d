"""Nearest neighbours by inner product: inverted lists, product-quantised residuals, exact reranking, a check by bounds.

Coarse centroids and the codebooks of the residuals are fitted on the driver from a bounded sample (SAMPLE rows, those
with the least hash of their id). Every vector is indexed: it goes to the list of its nearest centroid, with a code for
each slice of its residual. A query probes the PROBES lists whose centroids have the largest inner product with it. There
it sums one table of inner products per slice over the codes (asymmetric distances) and computes exact products of the
best RERANK, of which the k-th is a product that neighbours must reach. What reaches it in these lists is found by
products in single precision, and ranked by exact products of all that come within their error.

The sample says nothing about queries unlike it, so no list is left out for what the sample holds: a list has no product
above that of its centroid and the query's length times the list's radius, and each list whose bound reaches the k-th
best product found so far is searched in the same way, without codes. So the result is exact, and centroids and codes
decide only how much is looked at: few lists where vectors are clustered, up to all where they are not.

Lists are dealt into shards of bounded size, large lists into several. A query goes once to each shard in which it has
lists to see, and a task holds one shard, over which the queries pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from .common import free_shuffles, made, settled, stored

SAMPLE = 32768
MOST_LISTS = 1024
SLICES = 16
CODES = 256
RERANK = 128
#: Lists that a query probes by codes, before bounds decide on the others.
PROBES = 4
#: A shard's rows: a SHARDS-th of all, but not fewer than LEAST_SHARD nor more than SHARD_BYTES hold.
SHARDS = 24
LEAST_SHARD = 1024
SHARD_BYTES = 64_000_000
#: Vectors that meet a batch of queries at once, and pairs whose exact products are computed at once.
BLOCK = 4096
PAIRS = 50_000


def _means(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k different points; centroids without points stay."""
    rng = np.random.default_rng(seed)
    points = np.unique(points, axis=0)
    centroids = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(points[i : i + 1024] @ centroids.T - half).argmax(1) for i in range(0, len(points), 1024)] or [np.zeros(0, int)])


class Model:
    """Centroids and codebooks: at most MOST_LISTS + CODES vectors, sent to every task."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 7):
        dim = sample.shape[1]
        self.lists = int(min(MOST_LISTS, max(1, round(rows**0.5)), max(1, len(sample))))
        self.centroids = _means(sample, self.lists, 12, seed)
        self.lists = len(self.centroids)
        self.cuts = [round(i * dim / min(SLICES, dim)) for i in range(min(SLICES, dim) + 1)]
        residuals = sample - self.centroids[_nearest(sample, self.centroids)]
        self.books = [_means(residuals[:, a:b], min(CODES, len(residuals)), 8, seed + i) for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = _nearest(vectors, self.centroids)
        residuals = vectors - self.centroids[lists]
        codes = np.stack([_nearest(residuals[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1)
        return lists, codes.astype(np.uint8)

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, :n]

    def estimates(self, at: int, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products (queries x codes) in list `at`: the centroid's, and a table look-up for each slice."""
        out = np.repeat((queries @ self.centroids[at])[:, None], len(codes), axis=1)
        for s, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out += (queries[:, a:b] @ book.T)[:, codes[:, s]]
        return out


def _index(model: Model, kind: type):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                vectors = np.stack(frame["vector"].to_numpy()).astype(np.float64)
                lists, codes = model.encode(vectors)
                far, norm = np.linalg.norm(vectors - model.centroids[lists], axis=1), np.linalg.norm(vectors, axis=1)
                yield pd.DataFrame({"list": lists.astype(np.int32), "vec_id": frame["vec_id"], "vector": [v.tobytes() for v in vectors.astype(kind)], "code": [c.tobytes() for c in codes], "far": far, "norm": norm})

    return run


class Shards:
    """Which shards hold which lists: list j stands in shards first[j] to first[j] + parts[j] - 1. radius and reach are the
    greatest distance from the centroid and the greatest length of a list's vectors; lists without vectors have parts 0."""

    def __init__(self, model: Model, lists: list, size: int):
        self.parts, self.first = np.zeros(model.lists, int), np.zeros(model.lists, int)
        self.radius, self.reach = np.zeros(model.lists), np.zeros(model.lists)
        rows = {r["list"]: r["n"] for r in lists}
        for r in lists:
            self.radius[r["list"]], self.reach[r["list"]] = r["far"], r["norm"]
        # lists whose centroids are near each other stand together
        groups = _nearest(model.centroids, _means(model.centroids, min(SHARDS, model.lists), 8, 7))
        shard, held = 0, 0
        for j in np.argsort(groups, kind="stable"):
            n = rows.get(int(j), 0)
            if held and held + n > size:
                shard, held = shard + 1, 0
            self.first[j], self.parts[j] = shard, -(-n // size)
            if n > size:
                shard += int(self.parts[j])
            else:
                held += n
        self.count = shard + 1

    def of(self, at: F.Column, *row: str) -> F.Column:
        """The shard of a row in list `at`."""
        table = lambda values: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), at)
        return (table(self.first) + F.pmod(F.xxhash64(*row), table(np.maximum(self.parts, 1)))).cast("int")

    def bounds(self, model: Model, queries: np.ndarray) -> np.ndarray:
        """No product of a query and a vector of a list is above this, rounding included."""
        norm = np.linalg.norm(queries, axis=1)[:, None]
        near = queries @ model.centroids.T
        most = np.minimum(near + norm * self.radius, norm * self.reach)
        return np.where(self.parts > 0, most + 1e-9 * norm * (self.reach + np.linalg.norm(model.centroids, axis=1)), -np.inf)

    def shards(self, lists: np.ndarray) -> set[int]:
        return {int(f) + p for f, n in zip(self.first[lists], self.parts[lists]) for p in range(n)}


_ROW = "shard int, turn int, list int, vec_id long, vector binary, extra binary, least double"
_FOUND = "query_id long, vec_id long, score double"


def _route(model: Model, shards: Shards, kind: type, bounded: bool):
    """A row for each query and shard that it must see: in the first turn those of the lists it probes, then those of other
    lists whose bounds reach `least` (null: all)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), 1000):
                part = frame.iloc[start : start + 1000]
                queries = np.frombuffer(b"".join(part["vector"]), kind).reshape(len(part), -1).astype(np.float64)
                probed = model.probes(queries, PROBES)
                if bounded:
                    least = part["least"].astype(float).fillna(-np.inf).to_numpy()
                    open_ = ~(shards.bounds(model, queries) < least[:, None]) & (shards.parts > 0)
                    np.put_along_axis(open_, probed, False, 1)
                    goes = [sorted(shards.shards(np.flatnonzero(row))) for row in open_]
                else:
                    least = np.full(len(part), -np.inf)
                    goes = [sorted(shards.shards(row)) for row in probed]
                each = [len(g) for g in goes]
                at = np.repeat(np.arange(len(part)), each)
                extra = np.array([row.astype(np.int32).tobytes() for row in probed], dtype=object)
                yield pd.DataFrame({"shard": np.array([x for g in goes for x in g], np.int32), "turn": np.int32(1), "list": probed[at, 0].astype(np.int32), "vec_id": part["vec_id"].to_numpy()[at], "vector": part["vector"].to_numpy(dtype=object)[at], "extra": extra[at], "least": least[at]})

    return run


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Binaries of one length as the rows of a matrix, without a copy."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def needed_copies(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, without those of equal vectors that can't be among the k first of any query: of each, the k + 1
    smallest ids stay (one may be the query's own), with k rows each."""
    words = np.ascontiguousarray(vectors).view(np.uint32).astype(np.uint64)
    hashes = (words * np.random.default_rng(7).integers(1, 2**63, words.shape[1], dtype=np.uint64)).sum(1)
    order = np.lexsort((ids, hashes))
    same = np.append(False, hashes[order[1:]] == hashes[order[:-1]])
    if not same.any():
        return np.arange(len(ids))
    same[same] = (vectors[order[same]] == vectors[order[np.flatnonzero(same) - 1]]).all(1)
    again = same & np.append(False, ids[order[1:]] == ids[order[:-1]])
    places = np.arange(len(ids))
    numbered = np.cumsum(~again)
    nth_id = numbered - numbered[np.maximum.accumulate(np.where(same, 0, places))]
    nth_row = places - np.maximum.accumulate(np.where(again, 0, places))
    return np.sort(order[(nth_id <= k) & (nth_row < k)])


class _Best:
    """The k best of what some queries have found, and below what product nothing counts any more."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int):
        self.ids, self.least, self.k = ids, least.copy(), k
        self.held, self.waiting = [], 0

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((at, ids, score))
        self.waiting += len(at)
        if self.waiting > 64 * self.k * len(self.ids):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ids, score = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -score, at))
        at, ids, score = at[order], ids[order], score[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        last = nth == self.k - 1
        self.least[at[last]] = np.fmax(self.least[at[last]], score[last])
        keep = nth < self.k
        self.held, self.waiting = [(at[keep], ids[keep], score[keep])], 0
        return self.held[0]


class _Shard:
    """The vectors of a shard, by list and id, and what queries find among them."""

    def __init__(self, model: Model, k: int, rerank: int, parts: list):
        lists, ids, vectors, codes = (np.concatenate(x) for x in zip(*parts))
        self.model, self.k, self.rerank = model, k, rerank
        self.lists = {}
        for j in np.unique(lists):
            at = np.flatnonzero(lists == j)
            at = at[needed_copies(vectors[at], ids[at], k)]
            for start in range(0, len(at), BLOCK):
                some = at[start : start + BLOCK]
                self.lists.setdefault(int(j), []).append(self._block(ids[some], vectors[some], codes[some]))

    @staticmethod
    def _block(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> tuple:
        scale = float(np.abs(vectors).max())
        unit = (vectors / vectors.dtype.type(scale)).astype(np.float32) if scale else vectors.astype(np.float32)
        return ids, vectors, codes, scale, unit, float(np.sqrt((unit.astype(np.float64) ** 2).sum(1).max()))

    def probe(self, j: int, at: np.ndarray, queries: np.ndarray, best: _Best) -> None:
        """Raises the queries' least products to the k-th exact one among the best estimates in a block of list j."""
        for ids, vectors, codes, *_ in self.lists[j]:
            take = max(self.rerank, self.k)
            for start in range(0, len(at) if len(ids) > take else 0, 256):
                rows = at[start : start + 256]
                guess = self.model.estimates(j, queries[rows], codes)
                guess[best.ids[rows][:, None] == ids] = -np.inf
                near = np.argpartition(-guess, take - 1, axis=1)[:, :take]
                exact = np.einsum("qd,qkd->qk", queries[rows], vectors[near].astype(np.float64))
                exact[np.isneginf(np.take_along_axis(guess, near, 1))] = -np.inf
                best.least[rows] = np.fmax(best.least[rows], np.partition(exact, -self.k, axis=1)[:, -self.k])

    def check(self, j: int, at: np.ndarray, queries: np.ndarray, unit: np.ndarray, length: tuple, best: _Best) -> None:
        """Of list j all that reach the queries' least products: found in single precision, or double where too many are as
        near as its error."""
        for ids, vectors, _, scale, singles, norm in self.lists[j]:
            with np.errstate(all="ignore"):
                least = best.least[at] / length[0][at] / length[1][at] / scale
            least[~np.isfinite(least)] = -np.inf
            for kind, eps in ((np.float32, 6e-8), (np.float64, 1.2e-16)):
                others = singles if kind is np.float32 else vectors.astype(np.float64) / scale
                error = 2 * (queries.shape[1] + 8) * eps * norm
                products = unit[at].astype(kind) @ others.T
                rows = np.flatnonzero(products.max(1) >= least - error)
                if not len(rows):
                    break
                products, low = products[rows], least[rows]
                own = best.ids[at[rows]][:, None] == ids
                products[own] = -np.inf
                many = np.flatnonzero((products >= (low - error)[:, None]).sum(1) > 2 * self.k)
                if len(many):
                    # this list's own k-th is a bound too
                    low[many] = np.fmax(low[many], np.partition(products[many], -self.k, axis=1)[:, -self.k].astype(np.float64) - error)
                hits = (products >= (low - error)[:, None]) & ~own
                if kind is np.float64 or hits.sum() <= 16 * self.k * len(rows):
                    self._products(at[rows], np.nonzero(hits), ids, vectors, queries, best)
                    break

    @staticmethod
    def _products(rows: np.ndarray, pairs: tuple, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, best: _Best) -> None:
        for start in range(0, len(pairs[0]), PAIRS):
            of, to = rows[pairs[0][start : start + PAIRS]], pairs[1][start : start + PAIRS]
            best.add(of, ids[to], np.einsum("nd,nd->n", queries[of], vectors[to].astype(np.float64)))


def _search(model: Model, shards: Shards, k: int, rerank: int, kind: type, bounded: bool):
    """Rows sorted by (shard, turn, list, vec_id), a shard's vectors first, then its queries: the k best of each."""

    def asked(shard: _Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        queries = _matrix(batch.column("vector"), kind).astype(np.float64)
        probed = _matrix(batch.column("extra"), np.int32)
        best = _Best(batch.column("vec_id").to_numpy(), batch.column("least").to_numpy(), k)
        scale = np.abs(queries).max(1)
        norm = np.linalg.norm(queries / scale[:, None], axis=1)
        unit = queries / scale[:, None] / norm[:, None]
        seen = np.zeros((len(queries), model.lists), bool)
        np.put_along_axis(seen, probed.astype(np.int64), True, 1)
        bounds = shards.bounds(model, queries)
        for j in shard.lists:
            at = np.flatnonzero(~seen[:, j] & ~(bounds[:, j] < best.least) if bounded else seen[:, j])
            if len(at):
                if not bounded:
                    shard.probe(j, at, queries, best)
                shard.check(j, at, queries, unit, (scale, norm), best)
        at, ids, score = best.cut()
        return pa.record_batch({"query_id": best.ids[at], "vec_id": ids, "score": score})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, key, shard = [], None, None
        for batch in batches:
            marks = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("turn").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(marks)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                of, turn = divmod(int(marks[a]), 2)
                if of != key:
                    parts, key, shard = [], of, None
                some = batch.slice(a, b - a)
                if not turn:
                    codes = np.zeros((b - a, 0), np.uint8) if bounded else _matrix(some.column("extra"), np.uint8)
                    parts.append((some.column("list").to_numpy(), some.column("vec_id").to_numpy(), _matrix(some.column("vector"), kind).copy(), codes.copy()))
                elif parts or shard:
                    if shard is None:
                        shard, parts = _Shard(model, k, rerank, parts), []
                    yield asked(shard, some)

    return run


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part: id and vector given, no component null, NaN or infinite, not all
    zero, and as long as most vectors are (of lengths as frequent, the shortest)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    broken = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", broken) & F.exists("vector", lambda x: x != 0))
    usual = fine.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("vector") == (usual["d"] if usual else 0))


def sampled(rows: DataFrame, n: int, most: int = SAMPLE) -> np.ndarray:
    """The vectors of the `most` of n rows (vec_id, vector) whose ids have the least hashes, in that order.

    Rows beyond a bound on the hash go first, and the rest is sorted by executors: a sort with a limit that is collected
    sends `most` rows of every partition to the driver.
    """
    hashed, share = rows.withColumn("hash", F.xxhash64("vec_id")), 1.1 * most / n
    few = hashed.where(F.col("hash") <= F.lit(int(2**64 * share) - 2**63)) if share < 1 else hashed
    if share < 1 and few.count() < most:  # ids that repeat have one hash
        few = hashed
    least = stored(few.orderBy("hash", "vec_id").limit(most), "sample").toArrow()
    vectors = least["vector"].combine_chunks().flatten().to_numpy().reshape(least.num_rows, -1)
    return vectors[np.lexsort((least["vec_id"].to_numpy(), least["hash"].to_numpy()))]


def search(vectors: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets `queries` (a function of the id column), the k rows with
    the largest inner product, itself left out, ties to smaller ids. Rows with the query's own id count as itself.

    Null, zero and broken vectors take no part; an empty table gives no rows; repeated rows are each a candidate.
    """
    spark, since = vectors.sparkSession, made()
    rows = usable(vectors, vec_id, vector)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    given = vectors.schema[vector].dataType
    kind = np.float32 if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else np.float64
    points = sampled(rows, n)
    model = Model(points, n)
    size = max(LEAST_SHARD, min(-(-n // SHARDS), SHARD_BYTES // (points.shape[1] * np.dtype(kind).itemsize)))
    index = stored(rows.mapInPandas(_index(model, kind), "list int, vec_id long, vector binary, code binary, far double, norm double"), "index")
    shards = Shards(model, index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect(), size)
    asked = stored(index.where(queries(F.col("vec_id"))).select("vec_id", "vector"), "asked")

    def found(routed: DataFrame, bounded: bool) -> DataFrame:
        extra = F.lit(b"") if bounded else F.col("code")
        held = index.select(shards.of(F.col("list"), "vec_id", "vector").alias("shard"), F.lit(0).alias("turn"), "list", "vec_id", "vector", extra.alias("extra"), F.lit(None).cast("double").alias("least"))
        met = held.unionByName(routed.mapInPandas(_route(model, shards, kind, bounded), _ROW)).repartition(4 * shards.count, "shard")
        each = met.sortWithinPartitions("shard", "turn", "list", "vec_id").mapInArrow(_search(model, shards, k, rerank, kind, bounded), _FOUND)
        return stored(each, "found")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda some: some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    near = stored(ranked(found(asked, False)), "near")
    free_shuffles(spark)
    kth = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    more = found(asked.join(kth.hint("merge"), "vec_id", "left"), True)
    best = settled(ranked(near.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score"), "neighbours", since)
    free_shuffles(spark)
    return best


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 neighbours of every 20th of embeddings; nulls, broken vectors, ties, repeated rows, other columns and an empty
    table as in search()."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0, 20)
