"""Packing token sequences: best fit, then local search by exchanges between underfull bins.

Lengths are whole numbers up to the capacity, so all items of a length are alike and a packing is a list of patterns:
how many items of each length a bin holds, and how many bins are so filled. The driver holds only the number of items
per length, at most `capacity` numbers, and the patterns, at most some three per length and two per exchange; neither
follows the rows, since an exchange serves all bins of two patterns. Best fit goes from the longest items to the shortest. The local search then exchanges items
between two patterns (move one, one for one, two for one) in as many bin pairs as both patterns have, whenever that
increases the sum of squared fills; bins that it empties are gone. Rows learn their bin from the number they have
among the items of their length.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import per_worker, slices, stored, trimmed

Pattern = tuple[tuple[int, int], ...]  # (length, items of it), longest first


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit decreasing over lengths. counts: items per length, 1 to capacity.

    An item goes to the fullest bin with room for it. Bins with equal room are taken together: while the item fits
    again after itself, it goes to the same bin, so that q = room // length items fill one bin after another.
    """
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room
    rooms: list[int] = []

    def add(pattern: Pattern, room: int, bins: int) -> None:
        if bins:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((pattern, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                pattern, bins = groups[room].pop()
                if not groups[room]:
                    rooms.pop(k)
            else:
                room, pattern, bins = capacity, (), -(-left // (capacity // length))
            q = room // length
            full = min(bins, left // q)
            left -= full * q
            bins -= full
            add((*pattern, (length, q)), room - q * length, full)
            if bins and left:  # fewer than q are left for one more bin
                add((*pattern, (length, left)), room - left * length, 1)
                left, bins = 0, bins - 1
            if pattern:
                add(pattern, room, bins)
    out: Counter[Pattern] = Counter()
    for listed in groups.values():
        for pattern, bins in listed:
            out[pattern] += bins
    return out


def _without(pattern: Pattern, gone: tuple[int, ...], come: tuple[int, ...]) -> Pattern:
    held = Counter(dict(pattern))
    held.subtract(gone)
    held.update(come)
    return tuple(sorted(((k, v) for k, v in held.items() if v), reverse=True))


def local_search(packing: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Exchanges between underfull bins. From the emptier bin a to the fuller bin b go one item, or one or two items
    against one; an exchange is made if b still fits and b's fill plus what it gains exceeds a's fill, which is when the
    sum of squared fills grows. It ends when no pair has such an exchange, which growing sums make sure of.
    """
    fill = lambda p: sum(k * v for k, v in p)
    packing = Counter({tuple(sorted(p, reverse=True)): n for p, n in packing.items() if n})
    settled: set[tuple[Pattern, Pattern]] = set()
    while True:
        under = sorted((p for p in packing if fill(p) < capacity), key=lambda p: (fill(p), p))
        found = None
        for a in under:
            for b in reversed(under):
                if (a, b) in settled or fill(b) < fill(a) or (a == b and packing[a] < 2):
                    continue
                if found := _exchange(a, b, capacity - fill(b)):
                    break
                settled.add((a, b))
            if found:
                break
        if not found:
            return packing
        gone, come = found
        times = packing[a] // 2 if a == b else min(packing[a], packing[b])
        for old in (a, b):
            packing[old] -= times
            if not packing[old]:
                del packing[old]
        for new in (_without(a, gone, come), _without(b, come, gone)):
            if new:
                packing[new] += times


def _exchange(a: Pattern, b: Pattern, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """(items from a, items from b) with the largest gain of b within its room, or None."""
    from_a = [k for k, _ in a]
    pairs = [(x, y) for i, (x, n) in enumerate(a) for y in [*([x] if n > 1 else []), *from_a[i + 1 :]]]
    best, out = 0, None
    for gone in [*((x,) for x in from_a), *pairs]:
        total = sum(gone)
        for come in [(), *((y,) for y, _ in b)] if len(gone) == 1 else [(y,) for y, _ in b]:
            gain = total - sum(come)
            if best < gain <= room:
                best, out = gain, (gone, come)
    if out:
        return out
    for (x, n) in b:  # one of a against two of b, in the same bin of b
        for y in [*([x] if n > 1 else []), *(k for k, _ in b if k < x)]:
            for z in from_a:
                if best < z - x - y <= room:
                    best, out = z - x - y, ((z,), (x, y))
    return out


def pack(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    return local_search(best_fit(counts, capacity), capacity)


def places(packing: Counter[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, last number, items in a bin, first bin, offset): which items of a length go where.

    Item j, first <= j < last, lies in bin first_bin + (j - first) // q at offset + (j - first) % q * length.
    """
    used: Counter[int] = Counter()
    out, first_bin = [], 0
    for pattern, bins in sorted(packing.items(), reverse=True):
        offset = 0
        for length, q in pattern:
            out.append((length, used[length], used[length] + bins * q, q, first_bin, offset))
            used[length] += bins * q
            offset += q * length
        first_bin += bins
    return out


class _Chunks(dict):
    """The ids, as little-endian bytes, of a blank and a chunk without blanks. It keeps up to `most` chunks of at most
    LONGEST characters: when half of them are there, what was not asked for since the last time goes."""

    def __init__(self, encode, most: int):
        self.encode, self.most, self.old = encode, most // 2, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return _as_bytes(self.encode(" " + chunk))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.pop(chunk, None)
        if out is None:
            out = _as_bytes(self.encode(" " + chunk))
        self[chunk] = out
        return out


def _as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def byte_level(path: str):
    """An encoder with the ranks of a byte-level BPE file of tokenizers, or None where the file is of another kind.

    It gives the same ids several times as fast. It is taken only if the ids are the ranks of the merges, the text is
    cut by the usual pattern, and nothing else is done to it.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or not usual or spec.get("normalizer"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids) or len(merges) + 256 != len(model["vocab"]) - len(special & set(model["vocab"])):
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Chunks that a worker keeps, some 200 bytes each, and characters of the longest that it keeps.
CHUNKS = 200_000
LONGEST = 64


def _slowly(model, text: str) -> bytes:
    return _as_bytes(model.encode(text, add_special_tokens=False).ids)


def encoder(path: str, chunks: int = CHUNKS):
    """text -> its ids as little-endian bytes, those that the tokenizers file gives without special tokens.

    Where no white space stands beside a blank, a token never reaches over the place before a blank; so chunks between
    blanks have ids of their own, of which some are kept. Other texts are encoded whole.
    """
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    fast = byte_level(path)
    probes = ("It's  a\tprobe,\n\nÀé 12345 <|endoftext|> \u4e2d\U0001f600x ", "don't stop!! 'll\u00a0we")
    if not fast or any(fast.encode_ordinary(p) != model.encode(p, add_special_tokens=False).ids for p in probes):
        return partial(_slowly, model)
    del model  # only its rank table is needed from here on
    known = _Chunks(fast.encode_ordinary, chunks)
    white = [c for c in map(chr, range(sys.maxunicode)) if c.isspace()]

    def encode(text: str) -> bytes:
        if text[:1].isspace() or text[-1:].isspace() or any(c in text and (c + " " in text or " " + c in text) for c in white):
            return _as_bytes(fast.encode_ordinary(text))
        first, *rest = text.split(" ")
        return _as_bytes(fast.encode_ordinary(first)) + b"".join(map(known.__getitem__, rest))

    return encode


def _pieces(tokenizer: str, capacity: int, end: int, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = per_worker("encoder " + tokenizer, lambda: encoder(tokenizer)), _as_bytes([end])
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch):
                cols: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", *["ids"] * ids_too)}
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + last
                    n = len(ids) // 4
                    head = n if n <= capacity else n % capacity or capacity
                    for k, start in enumerate([0, *range(head, n, capacity)]):
                        length = head if not k else capacity
                        piece = ids[4 * start : 4 * (start + length)]
                        row = (doc, k, start, length, zlib.crc32(piece), task, seen[length])
                        seen[length] += 1
                        for c, v in zip(cols.values(), row):
                            c.append(v)
                        if ids_too:
                            cols["ids"].append(np.frombuffer(piece, dtype="<u4").tolist())
                kinds = {"doc_id": batch.schema.field(0).type, "piece": pa.int32(), "task": pa.int32(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()], names=list(cols))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, ids_too: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece's place in a sequence.

    tokenizer: path of a tokenizers file, on every machine. A document is its text's ids and `end`; null text is empty
    and so one id. Only documents over the capacity are cut: the first piece takes the remainder, so that the others
    are full. Each row is a document of its own, also with null or repeated doc_id. An empty table gives no rows.
    Texts are tokenised once, into a table of pieces; the rest works on that.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * ids_too
    pieces = stored(docs.select("doc_id", "text").mapInArrow(trimmed(_pieces(tokenizer, capacity, end, ids_too)), schema), "pieces")
    # a piece's number among all of its length: its number in the task plus the pieces of earlier tasks
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select(F.col("length").alias("of"), F.col("task").alias("in_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = places(pack(counts, capacity))
    spark = docs.sparkSession
    spans = spark.createDataFrame(table or [(0, 0, 0, 1, 0, 0)], "size long, lo long, hi long, q long, first_bin long, at long")
    numbered = pieces.join(bases, (F.col("length") == F.col("of")) & (F.col("task") == F.col("in_task"))).withColumn("j", F.col("nth") + F.col("base"))
    # the table of spans is bounded by the patterns (see above), whatever the rows
    placed = numbered.join(F.broadcast(spans), (F.col("length") == F.col("size")) & (F.col("j") >= F.col("lo")) & (F.col("j") < F.col("hi")))
    turn = F.col("j") - F.col("lo")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_bin") + F.floor(turn / F.col("q"))).cast("long").alias("sequence_id"),
        (F.col("at") + turn % F.col("q") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if ids_too else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences, from pack_documents(..., ids_too=True). A group holds one capacity of ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens; nulls, empty and long texts, ties, repeated rows, other
    columns and an empty table as in pack_documents()."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), 1024, 2)
