"""SimHash near-duplicates by an inverted index over the bytes of the fingerprints.

A posting list belongs to byte positions and the bytes there. Fingerprints that differ in at most r bits share at
least (bytes - r) bytes in place. Candidates come from posting lists over several positions at once, so that a list
stays short; of each candidate pair the bytes shared in place are tallied, pairs below the guaranteed number go, and
the rest is verified. Equal fingerprints are one entry, so copies never meet as pairs.

linked_groups() is exact for 64-bit fingerprints and 2 bits. near_duplicates() is for similarity of word sets: posting
lists of shingles that two similar texts are sure to share, wide fingerprints to pass over what only shares a passage,
and exact Jaccard similarity of the words' shingles at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, free_shuffles, if_small, made, settled, slices, stored, text_key, trimmed
from .graph import components
from .hashing import gram_set, word_hashes

SEED = 42
#: In links(), a posting list of more fingerprints is not paired but split by further bytes.
PAIRED = 48


def shingles(text: str | None, width: int) -> list[bytes]:
    """Word shingles, repeats included; A to Z lower-cased; fewer words than width: all of them; no words: none."""
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def hashes(text: str | None, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = shingles(text, width)
    return np.fromiter(map(xxh64_intdigest, found, repeat(SEED)), dtype=np.uint64, count=len(found))


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64 bits drawn from each hash; the first are the hash itself."""
    if not k:
        return h
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int = 64) -> bytes:
    """Bit i is 1 if it is set in over half of the hashes; without hashes all are 0. Most significant byte first."""
    out = b""
    for k in range(bits // 64):
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 65536):
            part = _spread(h[i : i + 65536], k)
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * ones > len(h)).tobytes()
    return out


def _fingerprints(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cols: list[list[int]] = [[] for _ in range(bits // 64)]
                for text in part.column("text").to_pylist():
                    words = np.frombuffer(fingerprint(hashes(text, width), bits), dtype=">i8")
                    for c, v in zip(cols, words.tolist()):
                        c.append(v)
                kept = [i for i, n in enumerate(part.schema.names) if n != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *(pa.array(c, pa.int64()) for c in cols)], names=[*(part.schema.names[i] for i in kept), *(f"f{k}" for k in range(len(cols)))])

    return run


def fingerprints(docs: DataFrame, width: int = 3, bits: int = 64) -> DataFrame:
    """The columns of docs but text, and the fingerprint as longs f0, f1, ... of 64 bits each."""
    others = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "text")
    return docs.mapInArrow(trimmed(_fingerprints(width, bits)), others + "".join(f", f{k} long" for k in range(bits // 64)))


def shared_bytes(a: list[Column], b: list[Column]) -> Column:
    """How many bytes the fingerprints share in place."""
    same = [F.when(F.shiftright(x.bitwiseXOR(y), 8 * i).bitwiseAND(255) == 0, 1).otherwise(0) for x, y in zip(a, b) for i in range(8)]
    return sum(same[1:], same[0])


def differing_bits(a: list[Column], b: list[Column]) -> Column:
    each = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)]
    return sum(each[1:], each[0])


def _byte_mask(positions: tuple[int, ...]) -> int:
    mask = sum(255 << (8 * p) for p in positions)
    return mask - 2**64 if mask >= 2**63 else mask


def _postings(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(list, key, fp): the posting lists a fingerprint is in, by number of the mask and the bytes under it."""
    keys = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("p")).select("p.list", "p.key", "fp")


def _within(bits: int):
    """Rows sorted by (list, key): spanning edges of the fingerprints of a key that differ in at most `bits` bits.

    A key fixes six bytes, so that a group has at most 65,536 fingerprints; work is a look-up per fingerprint and mask.
    """
    masks = [sum(1 << b for b in c) for r in range(1, bits + 1) for c in combinations(range(16), r)]

    def edges(values: np.ndarray, free: np.ndarray) -> pd.DataFrame:
        place = np.full(65536, -1, dtype=np.int64)
        place[free] = np.arange(len(free))
        pairs = []
        for m in masks:
            other = place[free ^ m]
            at = np.nonzero(other > np.arange(len(free)))[0]
            pairs.append(np.stack([at, other[at]]))
        a, b = np.concatenate(pairs, axis=1)
        root = np.arange(len(free))
        while True:  # least label of neighbours, then of the label's own label
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.nonzero(root != np.arange(len(free)))[0]
        return pd.DataFrame({"u": values[at], "v": values[root[at]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None

        def done() -> pd.DataFrame:
            rows = pd.concat(held)
            values = np.sort(rows["fp"].to_numpy().astype(np.int64))
            positions = SIX[key[0]]
            gap = [p for p in range(8) if p not in positions]
            u = values.view(np.uint64)
            byte = lambda p: (u >> np.uint64(8 * p)) & np.uint64(255)
            return edges(values, (byte(gap[0]) | (byte(gap[1]) << np.uint64(8))).astype(np.int64))

        for frame in frames:
            for k, rows in frame.groupby(["list", "key"], sort=True):
                if key is not None and k != key:
                    yield done()
                    held = []
                key = k
                held.append(rows)
        if held:
            yield done()

    return run


#: Two of four pairs of bytes: two differing bits leave at least two pairs alone. And six of eight bytes.
FOUR = [tuple(x for p in two for x in (2 * p, 2 * p + 1)) for two in combinations(range(4), 2)]
SIX = list(combinations(range(8), 6))


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """fps: distinct (fp). Edges (u, v) that connect just those fingerprints that chains of at most `bits` differing bits
    connect, bits being 1 or 2. Lists of up to PAIRED fingerprints give their pairs, tallied and verified. The
    fingerprints of longer lists go to lists over six bytes, at most 65,536 long, which give spanning edges.
    """
    if bits not in (1, 2):
        raise ValueError("the index guarantees 1 or 2 differing bits")
    postings = _postings(fps, [_byte_mask(p) for p in FOUR])
    sizes = postings.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stored(postings.join(sizes, ["list", "key"]), "crowded")
    few = crowded.where(F.col("n") <= PAIRED)
    a, b = few.select("list", "key", F.col("fp").alias("u")), few.select("list", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["list", "key"]).where("u < v").select("u", "v").distinct()
    least = 8 - bits
    close = pairs.where(shared_bytes([F.col("u")], [F.col("v")]) >= least).where(differing_bits([F.col("u")], [F.col("v")]) <= bits)
    rest = crowded.where(F.col("n") > PAIRED).select("fp").distinct()
    six = _postings(rest, [_byte_mask(p) for p in SIX])
    full = six.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    dealt = six.join(full, ["list", "key"]).repartition("list", "key").sortWithinPartitions("list", "key")
    return close.unionByName(dealt.mapInPandas(_within(bits), "u long, v long"))


def linked_groups(docs: DataFrame, width: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, f0 (fingerprint), component_id: the smallest doc_id of all documents that links lead to.

    Null and empty texts have fingerprint 0 and link like any other. Null doc_ids count for a component only if it has
    no other. Repeated rows are rows of their own in the same component. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs.select("doc_id", "text"), width), "fingerprints")
    per = stored(rows.groupBy(F.col("f0").alias("fp")).agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(per.select("fp"), bits))
    grouped = per.join(roots, per["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = grouped.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of, rows["f0"] == of["fp"]).select("doc_id", "f0", "component_id")


# Similarity of word sets. First, copies: posting lists of neighbouring bytes of wide fingerprints, where each text meets
# the least text of its lists. Groups of copies, however large, so become one entry in what follows. Then, the rest: of
# shingles in any one order, two sets with Jaccard similarity >= t share one at least among the first n - ceil(t n) + 1 of
# each, n being its size: a text's posting lists are those of these shingles. The order has shingles of many texts last, by
# how often a part of the texts has them, so that lists of common passages stay short; that part decides on the length of
# lists only, not on what is found. Before two sets are laid side by side, two counts must allow it: their fingerprints'
# differing bits, and the places in which the parities of the sets differ, which are never more than what only one of the
# sets has.
#: Fingerprints are of distinct shingles of three words: a changed word changes three of these but five of those that decide.
BITS = 256
PRINT_WIDTH = 3
#: Bits in which a pair may differ. Where a share s of the shingles of three words is common, some acos(s) / pi of the bits
#: differ: 39 of 256 at five-word similarity 0.8 if a block is appended (s = 0.89), 128 in texts that have nothing in common.
MOST_BITS = 96
#: In lists of shingles, the first 128 bits of the fingerprints alone are compared, by a bound of six standard deviations.
MOST_FIRST_BITS = 43
#: Bits of a set's parities: bit i is the parity of the number of its shingles whose hash ends in i.
PARITIES = 256
#: One in so many texts is counted for the order; shingles that so many of these have count as common, so many at most.
COUNTED = 16
COMMON = 4
MOST_COMMON = 200_000


def _distinct(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [gram_set(word_hashes(t, True), width) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["gram"])

    return run


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles that many of docs (key, text) have, and how often they are met in one of COUNTED texts."""
    part = docs.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0).dropDuplicates(["key"])
    counts = part.select("text").mapInArrow(trimmed(_distinct(width)), "gram long").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "gram").limit(MOST_COMMON).toPandas()
    grams, n = top["gram"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(grams)
    return grams[order], n[order]


def prefix(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Of a set of shingles, those that lead to all sets of at least this similarity. The empty set has 0 alone."""
    if not len(grams):
        return np.zeros(1, dtype=np.uint64)
    known, n = common
    often = np.zeros(len(grams), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        often = np.where(known[at] == grams, n[at], 0)
    return grams[np.lexsort((grams, often))[: len(grams) - math.ceil(threshold * len(grams) - 1e-9) + 1]]


def _post(width: int, threshold: float, common: tuple[np.ndarray, np.ndarray]):
    """(key, node, root, several): the posting lists of each text, of equal texts once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                cols = [part.column(c).to_pylist() for c in ("node", "root", "several")]
                new = []
                for i, (node, several) in enumerate(zip(cols[0], cols[2])):
                    if node not in seen:
                        new.append(i)
                        if several:
                            seen.add(node)
                if new:
                    texts = part.column("text")
                    found = [prefix(gram_set(word_hashes(texts[i].as_py(), True), width), common, threshold) for i in new]
                    sizes = [len(f) for f in found]
                    rows = [np.repeat(np.array([c[i] for i in new]), sizes) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *map(pa.array, rows)], names=["key", "node", "root", "several"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, packed): compressed texts, a third of the bytes of their shingles' hashes; of equal texts one a task."""
    import zstandard

    seen: set[int] = set()
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in slices(batch):
            nodes, texts = part.column("node").to_pylist(), part.column("text")
            new = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]
            found = [pack((texts[i].as_py() or "").encode()) for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.int64()), pa.array(found, pa.binary())], names=["node", "packed"])


#: Sets of shingles that a task keeps.
KEPT = 64


def _jaccard(width: int, threshold: float):
    """The rows (u, v, x, y), x and y being their packed texts, that have the similarity, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[int, np.ndarray] = {}

        def grams(node: int, packed) -> np.ndarray:
            if node not in known:
                if len(known) >= KEPT:
                    known.pop(next(iter(known)))
                known[node] = gram_set(word_hashes(unpack(packed.as_py()).decode(), True), width)
            return known[node]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("x"), batch.column("y")):
                x, y = grams(u, a), grams(v, b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


F4 = [f"f{k}" for k in range(BITS // 64)]
P4 = [f"p{k}" for k in range(PARITIES // 64)]


def parities(grams: np.ndarray) -> bytes:
    return np.packbits(np.bincount((grams % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).tobytes()


def _apart(a: str, b: str, threshold: float) -> Column:
    """Whether the parities in two structs allow that similarity: J >= t just if (1 + t) * |x ^ y| <= (1 - t) * (|x| + |y|)."""
    p, q = ([F.col(f"{at}.{c}") for c in P4] for at in (a, b))
    return F.lit(1 + threshold) * differing_bits(p, q) <= F.lit(1 - threshold) * (F.col(f"{a}.n") + F.col(f"{b}.n")) + 1e-6


def _alike(a: str, b: str, threshold: float) -> Column:
    x, y = ([F.col(f"{at}.{c}") for c in F4] for at in (a, b))
    return (differing_bits(x, y) <= MOST_BITS) & _apart(a, b, threshold)


#: What lists of shingles hold of a sketch.
FIRST = F4[:2]
BRIEF = [*FIRST, *P4, "n"]


def _brief(at: str) -> Column:
    return F.struct(*[F.col(f"{at}.{c}").alias(c) for c in BRIEF])


def _briefly_alike(a: str, b: str, threshold: float) -> Column:
    x, y = ([F.col(f"{at}.{c}") for c in FIRST] for at in (a, b))
    return (differing_bits(x, y) <= MOST_FIRST_BITS) & _apart(a, b, threshold)


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


SKETCH = [*F4, *P4, "n"]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    words = word_hashes(text, True)
                    grams = gram_set(words, width)
                    rows.append(fingerprint(gram_set(words, PRINT_WIDTH), BITS) + parities(grams) + len(grams).to_bytes(8, "big"))
                longs = np.frombuffer(b"".join(rows), dtype=">i8").reshape(len(rows), -1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(c) for c in longs.T)], names=["key", *SKETCH])

    return run


def numbered(docs: DataFrame, width: int) -> DataFrame:
    """docs: (key, text). (node, key, times, fp): each different text with a number, its rows, and a struct of its
    fingerprint f0.., the parities p0.. of its set of `width`-word shingles, and the size n of that."""
    since = made()
    prints = stored(docs.select("key", "text").mapInArrow(trimmed(_sketches(width)), "key binary, " + ", ".join(f"{c} long" for c in SKETCH)), "wide")
    each = prints.groupBy("key").agg(*[F.first(c).alias(c) for c in SKETCH], F.count(F.lit(1)).alias("times"))
    return settled(each.select(F.monotonically_increasing_id().alias("node"), "key", "times", F.struct(*SKETCH).alias("fp")), "nodes", since)


def byte_lists(nodes: int) -> list[tuple[int, int, int]]:
    """(long, first byte, bytes): the runs of neighbouring bytes that are posting lists, so wide that few of so many
    unrelated texts agree in one."""
    width = next(w for w in range(2, 8) if 256**w >= 8 * nodes)
    return [(k, at, width) for k in range(BITS // 64) for at in sorted({round(i * (8 - width) / 3) for i in range(4)})]


def hub_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """nodes: (node, fp). (u, v): each node v and, if it is another, the least u among the first nodes of v's lists of
    bytes whose sketches allow the threshold. Most copies of a text so lead to one and the same."""
    lists = byte_lists(nodes.count())
    keys = [F.struct(F.lit(i).alias("list"), F.shiftrightunsigned(f"fp.f{k}", 8 * at).bitwiseAND(F.lit(256**w - 1)).alias("key")) for i, (k, at, w) in enumerate(lists)]
    postings = nodes.select("node", F.explode(F.array(*keys)).alias("p")).select("p.list", "p.key", "node")
    first = postings.groupBy("list", "key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("u")).where("n > 1").drop("n")
    met = stored(postings.join(first, ["list", "key"]).where("u < node").select("u", F.col("node").alias("v")).distinct(), "met")
    x, y = (nodes.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "uv")
    return met.join(x, "u").join(y, "v").where(_alike("fp_u", "fp_v", threshold)).groupBy("v").agg(F.min("u").alias("u")).select("u", "v")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs of nodes (node, key) whose texts in docs (key, text) have Jaccard similarity >= threshold."""
    since = made()
    ends = stored(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "key"), "node"), "ends")
    texts = docs.select("key", "text").join(if_small(ends), "key").select("node", "text")
    packed = stored(texts.mapInArrow(trimmed(_packed), "node long, packed binary").dropDuplicates(["node"]), "packed")
    x, y = (packed.select(F.col("node").alias(at), F.col("packed").alias(p)) for at, p in (("u", "x"), ("v", "y")))
    out = settled(pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(trimmed(_jaccard(width, threshold)), "u long, v long"), "verified", since)
    free_shuffles(docs.sparkSession)
    return out


def crowded(postings: DataFrame) -> DataFrame:
    """The rows of (key, ...) whose key has another row. A hash table of keys would hold nearly all and combine nothing,
    a sort spills."""
    return postings.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1").drop("n")


def first_pairs(entries: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """entries: (key, root, node), one row for each group in a list. Pairs (u, v) of each list's first group with its
    others, of those whose sketches allow the threshold."""
    first = entries.groupBy("key").agg(F.min(F.struct("root", "node")).alias("first")).select("key", F.col("first.root").alias("root"), F.col("first.node").alias("node"))
    heads = first.join(prints, "node").select("key", F.col("root").alias("first"), F.col("node").alias("head"), F.col("fp").alias("head_fp"))
    met = entries.join(prints, "node").join(heads, "key").where((F.col("root") != F.col("first")) & _briefly_alike("fp", "head_fp", threshold))
    return met.select(*_ordered("node", "head")).distinct()


def other_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """members: (key, root, node, fp). Pairs (u, v) of a list's nodes in different groups, of those whose sketches allow it.
    The nodes of a list's largest group meet only those of others, so that a list of copies, however long, gives no pairs."""
    per = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top")).select("key", F.col("top.root").alias("most"))
    marked = members.join(most, "key")
    a = marked.where("root <> most").select(F.col("key").alias("ka"), F.struct("node", "root", "fp").alias("a"))
    b = marked.select(F.col("key").alias("kb"), F.struct("node", "root", "fp", "most").alias("b"))
    met = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("b.most")) | (F.col("a.node") < F.col("b.node")))
    return a.join(b, (F.col("ka") == F.col("kb")) & met & _briefly_alike("a.fp", "b.fp", threshold)).select(*_ordered("a.node", "b.node")).distinct()


def _rooted(rows: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """rows with root as it is in groups (node, root) for the node in column `by`; a node of no group is its own root."""
    now = groups.select(F.col("node").alias("_of"), F.col("root").alias("_now"))
    return rows.join(now, rows[by] == now["_of"], "left").withColumn("root", F.coalesce("_now", by)).drop("_of", "_now")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """docs: (key, text). Two tables: (key, node), a number for each different text; (node, root), the groups of
    texts that chains of Jaccard similarity >= threshold over `width`-word shingles connect, of nodes with a partner.

    Every pair that shares a posting list and whose sketches allow it is verified or already within one group: copies by
    lists of bytes; then, in lists of shingles, each group with the list's first until that links no more; then what is
    left between groups, each node with each.
    """
    texts = docs.select("key", "text")
    nodes = numbered(texts, width)
    prints = nodes.select("node", _brief("fp").alias("fp"))
    since = made()
    edges = verified(settled(hub_links(nodes, threshold), "hubs", since), texts, nodes, width, threshold)
    groups = components(edges)
    sizes = _rooted(nodes.select("key", "node", "times"), groups, "node")
    shared = groups.select("node").distinct().withColumn("linked", F.lit(True))
    labelled = sizes.join(shared, "node", "left").select("key", "node", "root", ((F.col("times") > 1) | F.coalesce("linked", F.lit(False))).alias("several"))
    own = texts.join(if_small(stored(labelled, "labelled")), "key").select("node", "root", "several", "text")
    posted = stored(own.mapInArrow(trimmed(_post(width, threshold, common_shingles(texts, width))), "key long, node long, root long, several boolean"), "postings")
    # a text that is no copy has one row for each of its lists; rows of copies become one for each group and list
    alone = posted.where("not several").select("key", "root", "node")
    together = posted.where("several").groupBy("key", "root").agg(F.min("node").alias("node"))
    entries = stored(crowded(alone.unionByName(together)), "entries")
    free_shuffles(texts.sparkSession)
    tried, open_lists = None, entries
    while True:
        pairs = first_pairs(open_lists, prints, threshold)
        pairs = stored(pairs.join(tried, ["u", "v"], "left_anti") if tried is not None else pairs, "firsts")
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = verified(pairs, texts, nodes, width, threshold)
        if links.isEmpty():
            break
        edges = edges.unionByName(links)
        groups = components(edges)
        moved = stored(_rooted(entries.select("key", "node", F.col("root").alias("was")), groups, "was"), "moved")
        entries = stored(crowded(moved.groupBy("key", "root").agg(F.min("node").alias("node"))), "entries")
        # a list whose groups are as they were has no new pair
        changed = stored(moved.where("was <> root").select("key").distinct(), "changed")
        open_lists = entries.join(if_small(changed), "key", "left_semi")
    left = stored(entries.select("key").distinct(), "left")
    if left.isEmpty():
        return nodes.select("node", "key"), groups
    members = posted.join(if_small(left), "key").select("key", "node").distinct()
    members = stored(_rooted(members, groups, "node").join(prints, "node"), "members")
    more = other_pairs(members, threshold)
    more = stored(more.join(tried, ["u", "v"], "left_anti") if tried is not None else more, "others")
    if more.isEmpty():
        return nodes.select("node", "key"), groups
    return nodes.select("node", "key"), components(edges.unionByName(verified(more, texts, nodes, width, threshold)))


def deduplicated(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group that with the smallest doc_id (null last).

    Texts without words are one group. Equal rows count as copies: one stays. An empty table stays empty. Other columns
    may have any names.
    """
    since = made()
    key, row, root, of, id_of, times = (free_name(docs, c) for c in ("_key", "_row", "_root", "_of", "_id", "_times"))
    keyed = docs.withColumn(key, text_key("text"))
    nodes, groups = near_duplicates(keyed.select(F.col(key).alias("key"), "text"), width, threshold)
    known = nodes.join(groups, "node", "left").select(F.col("key").alias(of), F.coalesce("root", "node").alias(root))
    ids = keyed.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("times"))
    ranked = ids.join(known, F.col(key) == F.col(of))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.col(key).alias("key"), "times")).alias("w")
    first = settled(ranked.groupBy(root).agg(least).select(F.col("w.doc_id").alias(id_of), F.col("w.key").alias(of), F.col("w.times").alias(times)), "winners", since)
    free_shuffles(docs.sparkSession)
    out = keyed.join(if_small(first), (F.col(key) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(id_of)))
    if first.where(F.col(times) > 1).isEmpty():
        return out.select(*docs.columns)
    again = out.where(F.col(times) > 1).withColumn(row, F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(0)))).where(F.col(row) == 1)
    return out.where(F.col(times) == 1).select(*docs.columns).unionByName(again.select(*docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents; nulls, empty texts, ties, repeated rows and an empty table as
    in linked_groups()."""
    out = linked_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")
