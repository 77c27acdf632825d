"""Repeated passages by MinHash banding of paragraphs.

Texts here have passages inside lines, so a paragraph is any WINDOW consecutive words. The MinHash of every paragraph
of a text is found by sliding minima over hashes of its five-word shingles; neighbouring paragraphs mostly share their
minimum, so a text has few different ones, its anchors, in each band. An anchor's two posting keys are the words from
it on and the words before it, KEY words each, so that common short lines meet nobody.

Texts that meet are paired with the least text of their key, and of its parts whose next or previous words agree over
39 words: in any two equal paragraphs one of those runs lies within, and pairs grow in proportion to occurrences. A pair
of paragraphs, beside each other at the distance of the anchors, repeats if the exact Jaccard similarity of their sets of
shingles is at least SIMILAR, words put in or left out between them included. Where the least text of a list has no
paragraph with another around the list's words, all texts of the list are paired if they are at most PAIRED and have the
words once; else the paragraphs around the anchors meet by hashes that all paragraphs that repeat share. Anchors in whose
paragraphs a shingle stands twice stand at each place of a run of one word, so they aren't paired place by place: equal
paragraphs are one, and different ones meet if they share one of the shingles, rare ones first, that such pairs are sure to
share. Of two texts, the passage is removed from the one with the larger number. Clusters are components of texts over
verified pairs. Copies of a text are one text until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, free_shuffles, if_small, made, n_words_of, settled, slices, stored, text_key, trimmed
from .graph import components
from .hashing import mix, runs, word_hashes

WINDOW = 50
WIDTH = 5
SIMILAR = 0.8
RECALL = 0.95
KEY = 16
BACK = KEY - WIDTH
LONG = 39
LONG_BACK = 23
#: In a list that its least text leaves open, so many texts at most are paired each with each; in longer ones, by signatures,
#: of which a place has hundreds: both find the same, and up to here pairs take less time and disk.
PAIRED = 128


def bands_for(similar: float = SIMILAR, recall: float = RECALL) -> int:
    """Bands of one MinHash each such that paragraphs at the threshold meet with at least this chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similar) - 1e-9))


def anchors(words: np.ndarray, bands: int) -> np.ndarray:
    """Places of the shingles that are the MinHash of some paragraph in some band."""
    grams, span = runs(words, WIDTH), WINDOW - WIDTH + 1
    found = []
    for b in range(bands):
        h = mix(grams ^ np.uint64(b * 0xD6E8FEB86659FD93 % 2**64))
        windows = np.lib.stride_tricks.sliding_window_view(h, span)
        for i in range(0, len(windows), 16384):
            part = windows[i : i + 16384]
            found.append(np.unique(part.argmin(1) + np.arange(i, i + len(part))))
    return np.unique(np.concatenate(found))


def _post(bands: int):
    """(key, node, q, ahead, behind, odd): posting keys of each text, with hashes of the longer runs beside them (0: none)
    and whether a shingle stands twice in a paragraph around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "q", "ahead", "behind", "odd"]
        for batch in batches:
            for part in slices(batch):
                out, seen = [], set()
                for node, text in zip(part.column("node").to_pylist(), part.column("text").to_pylist()):
                    if node in seen:
                        continue
                    seen.add(node)
                    words = word_hashes(text)
                    if len(words) < WINDOW:
                        continue
                    p = anchors(words, bands)
                    q = np.unique(np.concatenate([p, p - BACK]))
                    keys, long = runs(words, KEY), runs(words, LONG)
                    q = q[(q >= 0) & (q < len(keys))]
                    ahead = np.where(q < len(long), long[np.minimum(q, len(long) - 1)], np.uint64(0))
                    b = q - LONG_BACK
                    behind = np.where((b >= 0) & (b < len(long)), long[np.clip(b, 0, len(long) - 1)], np.uint64(0))
                    out.append((keys[q].view(np.int64), np.full(len(q), node), q.astype(np.int32), ahead.view(np.int64), behind.view(np.int64), _odd(words, q)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = [(word_hashes(t) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "words"])


def _before(grams: np.ndarray) -> np.ndarray:
    """The place before it where each gram last stood, or -1."""
    order = np.argsort(grams, kind="stable")
    same = np.nonzero(grams[order][1:] == grams[order][:-1])[0]
    out = np.full(len(grams), -1)
    out[order[same + 1]] = order[same]
    return out


def _counted(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """How many of the intervals (low, high] hold each of 0 .. n - 1. Interval ends are at least -1."""
    return np.cumsum(np.bincount(low + 1, minlength=n + 1)[: n + 1] - np.bincount(high + 1, minlength=n + 1)[: n + 1])[:n]


#: Shingles in a paragraph, and those by which the words of paragraphs that repeat can be shifted.
SPAN = WINDOW - WIDTH + 1


def _shift(similar: float) -> int:
    """k words put in between cost k + WIDTH - 1 shingles, of which a paragraph may lack as many as the similarity lets."""
    return max(0, SPAN - math.ceil(2 * SPAN * similar / (1 + similar) - 1e-9) - (WIDTH - 1))


def repeats(a: np.ndarray, b: np.ndarray, diagonal: int, similar: float = SIMILAR, before: tuple[np.ndarray, np.ndarray] | None = None, repeating: bool | None = None) -> list[tuple[int, int]]:
    """[start, end) in a, merged, of the paragraphs that repeat in b, the one at i beside that at i - diagonal in b.

    A shingle is in both if it stands in both paragraphs within _shift() places of the diagonal; it counts once, however
    often it does. before: _before() of the shingles of a and of b; repeating: whether any of them repeats within its text.
    """
    shift = _shift(similar)
    low, high = max(0, diagonal), min(len(a), len(b) + diagonal)
    if high - low < WINDOW:
        return []
    least = math.ceil(2 * SPAN * similar / (1 + similar) - 1e-9)

    def standing(x: int, y: int, d: int) -> np.ndarray:  # whether the shingle at each place from x to y - WIDTH is in b, d before
        same = a[x:y] == b[x - d : y - d]
        return same[:-4] & same[1:-3] & same[2:-2] & same[3:-1] & same[4:] if WIDTH == 5 else np.lib.stride_tricks.sliding_window_view(same, WIDTH).all(1)

    places = []
    for d in range(diagonal - shift, diagonal + shift + 1):
        x, y = max(0, d, low - shift), min(len(a), len(b) + d, high + shift)
        if y - x >= WIDTH:
            p = np.nonzero(standing(x, y, d))[0] + x
            if len(p):
                places.append((p, p - d))
    if not places:
        return []
    # only paragraphs that hold one of these
    low, high = max(low, min(int(p[0]) for p, _ in places) - SPAN - shift), min(high, max(int(p[-1]) for p, _ in places) + WINDOW + shift)
    if high - low < WINDOW:
        return []
    starts = high - low - WINDOW + 1  # of paragraphs, from low on
    in_a, in_b = before or (_before(runs(a.astype(np.uint64), WIDTH)), _before(runs(b.astype(np.uint64), WIDTH)))
    plain = repeating is False or (repeating is None and in_a.max() < 0 and in_b.max() < 0)
    if plain and sum(len(p) for p, _ in places) < least:
        return []
    p, q = places[0] if len(places) == 1 else (np.concatenate(x) for x in zip(*places))
    if plain and len(places) == 1 and p[0] - q[0] == diagonal:  # every shingle stands once, and only on the diagonal
        counts = np.zeros(starts + SPAN, dtype=np.int64)
        counts[p - low + 1] = 1
        counts = np.cumsum(counts)
        found = np.nonzero(counts[SPAN:] - counts[:-SPAN] >= least)[0] + low
    else:
        of_a, of_b = in_a[low : high - WIDTH + 1], in_b[low - diagonal : high - WIDTH + 1 - diagonal]
        at = np.arange(len(of_a))
        n_a = _counted(np.maximum(np.maximum(of_a - low, at - SPAN), -1), at, starts)
        n_b = _counted(np.maximum(np.maximum(of_b - low + diagonal, at - SPAN), -1), at, starts)
        first = np.maximum(np.maximum(p - SPAN, in_a[p]), np.maximum(q - SPAN, in_b[q]) + diagonal) - low
        last = np.minimum(np.minimum(p, q + diagonal) - low, starts - 1)
        first = np.maximum(first, -1)
        held = last > first
        both = _counted(first[held], last[held], starts)
        found = np.nonzero(both >= similar * (n_a + n_b - both) - 1e-9)[0] + low
    if not len(found):
        return []
    breaks = np.nonzero(np.diff(found) > WINDOW)[0]
    return [(int(s), int(e) + WINDOW) for s, e in zip(found[np.concatenate([[0], breaks + 1])], found[np.concatenate([breaks, [len(found) - 1]])])]


#: Texts whose repeated shingles a task keeps.
KEPT = 200


def _verify(similar: float):
    """(u, v, d, us, ue, vs, ve) of each pair's paragraphs, d being the distance of the anchors."""
    names = ["u", "v", "d", "us", "ue", "vs", "ve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray, bool]] = {}

        def text(node: int, words) -> tuple[np.ndarray, np.ndarray, bool]:
            if node not in known:
                if len(known) >= KEPT:
                    known.clear()
                own = np.frombuffer(words.as_py(), np.uint32)
                before = _before(runs(own.astype(np.uint64), WIDTH))
                known[node] = own, before, bool(before.max() >= 0)
            return known[node]

        for batch in batches:
            rows = []
            for u, v, diagonals, x, y in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("diagonals"), batch.column("x"), batch.column("y")):
                (a, in_a, more_a), (b, in_b, more_b) = text(u, x), text(v, y)
                for d in diagonals.as_py():
                    rows += [(u, v, d, s, e, s - d, e - d) for s, e in repeats(a, b, d, similar, (in_a, in_b), more_a or more_b)]
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return run


#: A paragraph that repeats with a word changed, put in or left out has a run of so many words on one side of it.
HALF = 24
#: Words that lie in both of two such paragraphs, without the word at their split.
REST = WINDOW - 1


def _near(at: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """The places from before to after each of at, of those from 0 to n - 1."""
    near = np.unique((np.asarray(at)[:, None] + np.arange(before, after + 1)).ravel())
    return near[(near >= 0) & (near < n)]


def _odd(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a shingle stands twice in one of the paragraphs around each of the anchors at."""
    before = _before(runs(words, WIDTH))
    twice = np.nonzero((before >= 0) & (np.arange(len(before)) - before < SPAN))[0]
    return np.searchsorted(twice, at + WINDOW - WIDTH, "right") > np.searchsorted(twice, at + KEY - WINDOW)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, s, odd): the given anchors, as odd, in whose paragraphs a shingle stands twice; and the hash of every run of
    HALF words in the paragraphs around the others."""
    for batch in batches:
        for part in slices(batch):
            out = []
            for node, at, text in zip(part.column("node").to_pylist(), part.column("at").to_pylist(), part.column("text")):
                words = word_hashes(text.as_py())
                h, at = runs(words, HALF), np.array(at)
                odd = _odd(words, at)
                s, q = _near(at[~odd], KEY - WINDOW, WINDOW - HALF, len(h)), at[odd]
                out.append((h[s].view(np.int64), np.full(len(s), node), s.astype(np.int32), np.zeros(len(s), bool)))
                out.append((np.zeros(len(q), np.int64), np.full(len(q), node), q.astype(np.int32), np.ones(len(q), bool)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "node", "s", "odd"])


def signatures(words: np.ndarray, at: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) by which the paragraphs around the anchors at meet all others that repeat them.

    Where no shingle stands twice, two paragraphs that repeat at SIMILAR have 41 shingles of 46 in common: either a run of
    45 words, or two runs of REST words together, between which one of the texts, or both, has a word. So the hash is of the
    run, or of both runs and the place of the split, with and without a word there; any two with one hash do repeat.
    shared: whether the run of HALF words at each place is in another text; other paragraphs give nothing.
    """
    n, found = len(words), []
    x = runs(words, WINDOW - WIDTH)
    s = _near(at, KEY - WINDOW + WIDTH, 0, len(x))
    s = s[shared[s]]
    found.append((x[s], s))
    starts = _near(at, KEY - WINDOW, 0, n - REST + 1)
    for k in range(WIDTH, REST - WIDTH + 1):
        x, y = runs(words, k), runs(words, REST - k)
        for gap in (0, 1):
            s = starts[starts <= n - REST - gap]
            s = s[shared[s]] if k > HALF else s[shared[s + REST + gap - HALF]]
            if len(s):
                place = np.where(s + WINDOW <= n, s, np.maximum(s - 1, 0))  # of a whole paragraph
                found.append((mix(x[s] ^ mix(y[s + k + gap] + np.uint64(k))), place))
    h, s = (np.concatenate(c) for c in zip(*found))
    return h, s


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, s) of the given anchors but those in whose paragraphs a shingle stands twice, which meet all others anyway."""
    for batch in batches:
        for part in slices(batch, rows=32):
            out = []
            for node, at, half, text in zip(part.column("node").to_pylist(), part.column("at").to_pylist(), part.column("half").to_pylist(), part.column("text")):
                words = word_hashes(text.as_py())
                shared, at = np.zeros(len(words), bool), np.array(at)
                shared[half] = True
                h, s = signatures(words, at[~_odd(words, at)], shared)
                out.append((h.view(np.int64), np.full(len(s), node), s.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "node", "s"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, s): every paragraph around the given anchors."""
    for batch in batches:
        for part in slices(batch):
            out = []
            for node, at, text in zip(part.column("node").to_pylist(), part.column("at").to_pylist(), part.column("text")):
                h = runs(word_hashes(text.as_py()), WINDOW)
                s = _near(at, KEY - WINDOW, 0, len(h))
                out.append((h[s].view(np.int64), np.full(len(s), node), s.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "node", "s"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, p): the shingles in the given paragraphs."""
    for batch in batches:
        for part in slices(batch):
            out = []
            for node, starts, text in zip(part.column("node").to_pylist(), part.column("starts").to_pylist(), part.column("text")):
                h = runs(word_hashes(text.as_py()), WIDTH)
                p = _near(starts, 0, SPAN - 1, len(h))
                out.append((h[p].view(np.int64), np.full(len(p), node), p.astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "node", "p"])


def prefixes(grams: np.ndarray, counts: np.ndarray, starts: np.ndarray, similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """(start, place): of each paragraph, its rarest shingles, each where it stands first, so many that those of any two that
    repeat have one in common. grams, counts: of each place of the text.

    What two such paragraphs share is at least SIMILAR of either; so the first in order of what they share has no more
    before it in either than the rest of the paragraph's shingles.
    """
    order = np.lexsort((grams, counts))
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(grams[order][1:] != grams[order][:-1])])
    before, found = _before(grams), []
    for i in range(0, len(starts), 4096):
        at = starts[i : i + 4096, None] + np.arange(SPAN)
        first = before[at] < starts[i : i + 4096, None]
        by = np.argsort(np.where(first, rank[at], len(grams)), axis=1, kind="stable")
        n = first.sum(1)
        kept = np.arange(SPAN) < (n - np.ceil(similar * n - 1e-9).astype(np.int64) + 1)[:, None]
        row, col = np.nonzero(kept)
        found.append((starts[i + row], starts[i + row] + by[row, col]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _prefixes(similar: float):
    """(h, node, p, odd): prefixes() of the given paragraphs; odd: of one around an anchor in whose paragraphs a shingle stands twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for node, at, starts, grams, text in zip(part.column("node").to_pylist(), part.column("at").to_pylist(), part.column("starts").to_pylist(), part.column("grams"), part.column("text")):
                    words, at = word_hashes(text.as_py()), np.array(at)
                    h, counts = runs(words, WIDTH), np.zeros(len(words) - WIDTH + 1, np.int64)
                    counts[grams.values.field("p").to_numpy()] = grams.values.field("n").to_numpy()
                    s, p = prefixes(h, counts, np.sort(np.array(starts)), similar)
                    odd = np.isin(s, _near(at[_odd(words, at)], KEY - WINDOW, 0, len(words)))
                    for kind in (False, True):
                        places = np.unique(p[odd == kind])
                        out.append((h[places].view(np.int64), np.full(len(places), node), places.astype(np.int32), np.full(len(places), kind)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "node", "p", "odd"])

    return run


def _union(frames):
    """Merges each text's spans; a kept span within removed ones is left out."""
    import pandas as pd

    for frame in frames:
        out = []
        for node, spans in zip(frame["node"], frame["spans"]):
            merged: dict[bool, list[list[int]]] = {True: [], False: []}
            for s in sorted((x["s"], x["e"], x["removed"]) for x in spans):
                own = merged[bool(s[2])]
                if own and s[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s[1])
                else:
                    own.append([s[0], s[1]])
            gone = merged[True]
            out += [(node, s, e, True) for s, e in gone]
            out += [(node, s, e, False) for s, e in merged[False] if not any(a <= s and e <= b for a, b in gone)]
        yield pd.DataFrame(out, columns=["node", "start", "end", "removed"])


def repeated_passages(keyed: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """keyed: (node, text), node being a number of the text. Returns (node, start, end, removed), word places of repeated
    passages, and (node, root), the clusters of texts that share some."""
    since = made()
    posted = stored(keyed.mapInArrow(trimmed(_post(bands_for(similar, recall))), "key long, node long, q int, ahead long, behind long, odd boolean"), "anchors")
    met = stored(posted.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key"), "met")
    crowded = settled(posted.join(if_small(met), "key").distinct(), "crowded", since)
    free_shuffles(keyed.sparkSession)

    def stars(*extra: str) -> DataFrame:  # (key, u, v, d, q, odd): v's place in the text of the lead u is d further on; odd: both places
        rows = crowded.where(F.col(extra[0]) != 0) if extra else crowded
        # a table of its own, so that the join of a hot key can be split
        leads = stored(rows.groupBy("key", *extra).agg(F.min(F.struct("node", "q", "odd")).alias("lead")), "leads")
        return rows.join(leads, ["key", *extra]).where(F.col("lead.node") != F.col("node")).select("key", F.col("lead.node").alias("u"), F.col("node").alias("v"), (F.col("lead.q") - F.col("q")).alias("d"), "q", (F.col("odd") & F.col("lead.odd")).alias("odd"))

    def checked(pairs: DataFrame) -> DataFrame:  # pairs: (u, v, d)
        before = made()
        per = stored(pairs.groupBy("u", "v").agg(F.collect_set("d").alias("diagonals")), "pairs")
        ends = stored(per.select("u").union(per.select("v")).distinct().withColumnRenamed("u", "node"), "ends")
        words = stored(keyed.join(if_small(ends), "node").mapInArrow(trimmed(_texts), "node long, words binary").dropDuplicates(["node"]), "words")
        x, y = (words.select(F.col("node").alias(at), F.col("words").alias(w)) for at, w in (("u", "x"), ("v", "y")))
        out = settled(per.join(x, "u").join(y, "v").mapInArrow(trimmed(_verify(similar)), "u long, v long, d int, us int, ue int, vs int, ve int"), "verified", before)
        free_shuffles(keyed.sparkSession)
        return out

    before = made()
    long = stored(stars("ahead").unionByName(stars("behind")).distinct(), "long")
    starred = settled(stars().unionByName(long).distinct(), "stars", before)
    met_pairs = starred.where("not odd")
    found = checked(met_pairs)
    # where the least text of a list has no paragraph with another at that place, others of the list may have one
    sure = found.select("u", "v", "d", "vs", "ve")
    unsure = met_pairs.join(sure, ["u", "v", "d"], "left").groupBy("key", "u", "v", "d", "q").agg(F.max(F.coalesce((F.col("vs") <= F.col("q")) & (F.col("q") + KEY <= F.col("ve")), F.lit(False))).alias("sure"))
    # a list with odd places is open also if it has but two
    unmet = stored(unsure.where("not sure").select("key", F.lit(False).alias("two")).unionByName(starred.where("odd").select("key", F.lit(True).alias("two"))).groupBy("key").agg(F.max("two").alias("two")), "unmet")
    open_lists = stored(crowded.join(unmet, "key").select("key", "node", "q", "odd", "two").distinct(), "open")
    sizes = open_lists.groupBy("key").agg(F.count_distinct("node").alias("n"), F.count(F.lit(1)).alias("places"), F.max("two").alias("two")).where("n > 2 or places > n or two").drop("two")
    open_lists = stored(open_lists.drop("two").join(sizes, "key"), "sized")
    short = (F.col("n") <= PAIRED) & (F.col("places") == F.col("n"))

    def pairs_of(a: DataFrame, b: DataFrame, met: str) -> DataFrame:  # each place of one with each of the other
        u, v = a.select("key", F.col("node").alias("a"), F.col("q").alias("p")), b.select("key", F.col("node").alias("b"), "q")
        return u.join(v, "key").where(met).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.expr("if(a < b, p - q, q - p)").alias("d")).distinct()

    before = made()
    # in long lists, and where a text has a place twice, paragraphs meet by signatures
    rest = open_lists.where(~short)
    around = stored(rest.groupBy("node").agg(F.collect_set("q").alias("at")), "around")
    dealt = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # so many tasks, however few bytes
    own = stored(keyed.join(if_small(around), "node").select("node", "text", "at").dropDuplicates(["node"]), "own")
    halves = stored(own.mapInArrow(trimmed(_halves), "h long, node long, s int, odd boolean").where("not odd").drop("odd"), "halves")
    twice = halves.groupBy("h").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("h")
    half = halves.join(twice, "h").groupBy("node").agg(F.collect_set("s").alias("half"))
    signed = stored(own.join(half, "node").repartition(dealt, "node").mapInArrow(trimmed(_signatures), "h long, node long, s int"), "signed")
    free_shuffles(keyed.sparkSession)
    leads = stored(signed.groupBy("h").agg(F.min(F.struct("node", "s")).alias("lead"), F.max("node").alias("most")).where("lead.node <> most").drop("most"), "leads")
    near = settled(signed.join(leads, "h").where(F.col("lead.node") != F.col("node")).select(F.col("lead.node").alias("u"), F.col("node").alias("v"), (F.col("lead.s") - F.col("s")).alias("d")).distinct(), "near", before)
    free_shuffles(keyed.sparkSession)

    # where a shingle stands twice: equal paragraphs each repeat that of the least text, or, in it, that of the last
    before = made()
    lists = rest.join(rest.where("odd").select("key").distinct(), "key")
    around = stored(lists.groupBy("node").agg(F.collect_set("q").alias("at")), "around")
    own = stored(keyed.join(if_small(around), "node").select("node", "text", "at").dropDuplicates(["node"]), "own")
    windows = stored(own.repartition(dealt, "node").mapInArrow(trimmed(_windows), "h long, node long, s int"), "windows")
    ends = stored(windows.groupBy("h").agg(F.min(F.struct("node", "s")).alias("x"), F.max(F.struct("node", "s")).alias("y")), "ends")
    least = F.col("node") == F.col("x.node")
    u, us, v, vs = F.col("x.node"), F.when(least, F.col("s")).otherwise(F.col("x.s")), F.col("y.node"), F.when(least, F.col("y.s")).otherwise(F.col("s"))
    equal = windows.join(ends.where("x.node <> y.node"), "h").select(u.alias("u"), F.when(least, v).otherwise(F.col("node")).alias("v"), us.alias("us"), (us + WINDOW).alias("ue"), vs.alias("vs"), (vs + WINDOW).alias("ve")).distinct()
    found = stored(found.drop("d").unionByName(equal), "equal")
    # different ones, each in its least and its last text, meet by rare shingles
    starts = ends.select(F.explode(F.array("x", "y")).alias("x")).select("x.*").groupBy("node").agg(F.collect_set("s").alias("starts"))
    own = stored(own.join(starts, "node"), "own")
    grams = stored(own.repartition(dealt, "node").mapInArrow(trimmed(_grams), "h long, node long, p int"), "grams")
    counts = grams.join(grams.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h").groupBy("node").agg(F.collect_list(F.struct("p", "n")).alias("grams"))
    rare = stored(own.join(counts, "node").repartition(dealt, "node").mapInArrow(trimmed(_prefixes(similar)), "h long, node long, p int, odd boolean"), "rare")
    others = rare.where("odd").select("h", F.col("node").alias("a"), "p").join(rare.select("h", F.col("node").alias("b"), F.col("p").alias("q")).distinct(), "h").where("a <> b")
    shift = _shift(similar)
    others = others.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.expr("if(a < b, p - q, q - p)").alias("d")).distinct()
    others = others.withColumn("d", F.explode(F.sequence(F.col("d") - shift, F.col("d") + shift)))
    others = pairs_of(open_lists.where(short), open_lists.where(short), "a < b").unionByName(near).unionByName(others).distinct()
    others = stored(others.join(met_pairs.select("u", "v", "d").distinct(), ["u", "v", "d"], "left_anti"), "others")
    found = stored(found.unionByName(checked(others).drop("d")), "found")
    free_shuffles(keyed.sparkSession)
    sides = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("us").alias("s"), F.col("ue").alias("e"), F.lit(False).alias("removed")), F.struct(F.col("v").alias("node"), F.col("vs").alias("s"), F.col("ve").alias("e"), F.lit(True).alias("removed"))))
    spans = found.select(sides.alias("x")).select("x.*").distinct()
    per = spans.groupBy("node").agg(F.collect_list(F.struct("s", "e", "removed")).alias("spans"))
    passages = per.mapInPandas(_union, "node long, start int, end int, removed boolean")
    return stored(passages, "passages"), components(found.select("u", "v"))


def duplicated(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, cluster_id, removed: word places of passages that repeat in other documents.

    Documents that share no passage have no row. Of equal texts of at least WINDOW words, that with the smallest doc_id
    (null last) has the text's own passages and a kept row for the whole text; in each other, and in rows that repeat
    the doc_id, the whole text is removed. cluster_id is the smallest doc_id of a cluster. Null and empty texts and
    texts of fewer words than a paragraph share nothing; texts count whole however long. An empty table gives no rows. Extra
    columns are ignored.
    """
    named = docs.select("doc_id", "text", text_key("text").alias("of"))
    nodes = stored(named.select("of").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = named.join(if_small(nodes), "of").select("doc_id", "text", "node")
    passages, groups = repeated_passages(keyed.select("node", "text"))
    rows = stored(keyed.select("doc_id", "node", n_words_of(F.col("text")).alias("n")), "rows")
    per = rows.where(F.col("n") >= WINDOW).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    known = stored(per.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")), "texts")
    cluster = known.groupBy("root").agg(F.min("least").alias("cluster_id"))
    texts = known.join(cluster, "root")
    own = texts.join(passages, "node").select(F.col("least").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("end") - F.col("start")).cast("long").alias("n_words"), "cluster_id", "removed")
    copies = rows.where(F.col("n") >= WINDOW).join(texts.where("times > 1").select("node", "least", "cluster_id", "times"), "node")
    # of rows with the least doc_id one is kept; where that id repeats, the others can't be told from it
    per_id = copies.groupBy("node", "doc_id", "least", "cluster_id", "n").agg(F.count(F.lit(1)).alias("same"))
    each = per_id.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    whole = each.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.col("n").alias("n_words"), "cluster_id", (~F.col("doc_id").eqNullSafe(F.col("least")) | (F.col("turn") > 1)).alias("removed"))
    return own.unionByName(whole)


def _cut(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^ \t-\r]+")
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist()):
                if spans and text:
                    at = [m.span() for m in word.finditer(text)]
                    merged: list[list[int]] = []
                    for s, e in sorted((x["start"], min(x["end"], len(at))) for x in spans if x["start"] < len(at)):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in reversed(merged):
                        text = text[: at[s][0]] + text[at[e - 1][1] :]
                texts.append(text)
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept], names=kept)

    return run


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removed passages cut from text; other columns, of any names, stay as they are.

    Rows are cut by doc_id, also null, so that it should be unique: of rows that share one, each loses what any of them
    does. Null and empty texts stay; an empty table stays empty.
    """
    of, spans = free_name(docs, "_of"), free_name(docs, "_spans")
    gone = duplicated(docs).where("removed").groupBy(F.col("doc_id").alias(of)).agg(F.collect_set(F.struct("start", "end")).alias(spans))
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(of)), "left").select(*docs.columns, spans)
    return joined.mapInArrow(_cut(spans), docs.schema)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; nulls, empty and long texts, ties, repeated rows, other columns and an empty
    table as in duplicated()."""
    return duplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
