"""Line dedup by log templates.

Lines are parsed as logs are: in lines of MIN_TOKENS or more, tokens that hold a digit or an address become <*>; a tree of
fixed depth deals the lines by their number of tokens and then their leading tokens; in a leaf, a line joins the first
template that agrees in at least SIMILAR of its tokens, and the tokens that differ become <*>. A template recurs if at
least `min_docs` different texts have a line of it, of which near copies of each other (simhash.near_duplicates, as in
the near-duplicate stage) count as one: what only they share is left to that stage. Its lines are dropped from every
text in which anything else stands.

Equal texts are told apart by their digest and count once. A leaf's depth grows with the length of its lines. A leaf of
any size is parsed in parts and then the parts' templates in turn; the templates that a line may join are looked up by
place and token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, free_shuffles, if_small, made, settled, slices, stored, text_key, trimmed
from .simhash import near_duplicates

#: Different texts in which a template must occur, and the tokens from which a line has variable ones; shorter lines are
#: templates as they stand.
MIN_DOCS = 10
MIN_TOKENS = 3
SIMILAR = 0.75
#: Characters of lines that a task holds before it passes on what it has counted.
HELD_CHARS = 8_000_000

_VARIABLE = re.compile(r"\d|://|@")
_search = _VARIABLE.search


def mask(line: str, min_tokens: int = MIN_TOKENS) -> list[str]:
    tokens = line.split()
    if len(tokens) < min_tokens:
        return tokens
    return ["<*>" if _search(t) else t for t in tokens] if _search(line) else tokens


def leaf_of(tokens: list[str]) -> list[str]:
    """The path through the tree: the number of tokens and, after it, leading tokens, more of them in longer lines."""
    return [str(len(tokens)), *tokens[: 3 + len(tokens) // 10]]


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def _count(min_docs: int, min_tokens: int):
    """(leaf, line, masked line, up to min_docs keys of different texts) of what a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        held: dict[str, bytes | set[bytes]] = {}  # most lines have one key
        chars = 0

        def out() -> pa.RecordBatch:
            cols: tuple[list, ...] = ([], [], [], [])
            for line, keys in held.items():
                tokens = mask(line, min_tokens)
                if tokens:
                    masked = " ".join(tokens)
                    row = xxh64_intdigest("\0".join(leaf_of(tokens))) >> 1, _signed(xxh64_intdigest(masked)), masked, [keys] if isinstance(keys, bytes) else list(keys)
                    for c, v in zip(cols, row):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["leaf", "line", "masked", "keys"])

        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    for line in (text or "").split("\n"):
                        keys = held.get(line)
                        if keys is None:
                            held[line] = key
                            chars += len(line)
                        elif isinstance(keys, bytes):
                            if keys != key:
                                held[line] = {keys, key}
                        elif len(keys) < min_docs:
                            keys.add(key)
                if chars > HELD_CHARS:
                    yield out()
                    held, chars = {}, 0
        if held:
            yield out()

    return run


def templates(lines: list[tuple[tuple[str, ...], set]]) -> list[tuple[list[str], list[int]]]:
    """(template, numbers of its lines) for the lines of one leaf, all of one length, in a fixed order.

    A line and a template that agree in SIMILAR of their tokens agree in one at least of any places that are more than
    the others, so that the line's least frequent tokens lead to all templates that it may join.
    """
    found: list[tuple[list[str], list[int]]] = []
    having: dict[tuple[int, str], set[int]] = {}
    for i, (tokens, _) in enumerate(lines):
        most = int((1 - SIMILAR) * len(tokens) + 1e-9)  # places that may differ
        met = sorted((having.get(at, ()) for at in enumerate(tokens)), key=len)[: most + 1]
        for k in sorted(set().union(*met)):
            template, own = found[k]
            same = sum(a == b for a, b in zip(template, tokens))
            constant = sum(a == b != "<*>" for a, b in zip(template, tokens))
            if same >= SIMILAR * len(tokens) and 2 * constant >= len(tokens):
                for place, (a, b) in enumerate(zip(template, tokens)):
                    if a != b and a != "<*>":
                        having[place, a].discard(k)
                        having.setdefault((place, "<*>"), set()).add(k)
                        template[place] = "<*>"
                own.append(i)
                break
        else:
            for at in enumerate(tokens):
                having.setdefault(at, set()).add(len(found))
            found.append((list(tokens), [i]))
    return found


#: Parts into which a leaf's lines are dealt, by hash, before their templates meet.
PARTS = 1024


def _generalise(min_docs: int, last: bool):
    """Rows (leaf, part, masked, keys) sorted by leaf and part. For each line of a part, its template, the first of whose
    lines has up to min_docs of its keys: (leaf, line, named, masked, keys). At last, (line, template) of the lines whose
    template enough different texts have."""

    def parsed(leaf: int, masked: list[str], keys: list[list[bytes]]) -> Iterator[tuple]:
        from xxhash import xxh64_intdigest

        merged: dict[str, set] = {}
        for line, own in zip(masked, keys):
            merged.setdefault(line, set()).update(own)
        by_length: dict[int, list] = {}
        for line, own in sorted(merged.items()):
            tokens = tuple(line.split(" "))
            by_length.setdefault(len(tokens), []).append((tokens, own))
        for lines in by_length.values():
            for template, members in templates(lines):
                held, name = set().union(*(lines[i][1] for i in members)), " ".join(template)
                hashes = [_signed(xxh64_intdigest(" ".join(lines[i][0]))) for i in members]
                if last and len(held) >= min_docs:
                    yield from ((h, name) for h in hashes)
                if not last:
                    named, few = _signed(xxh64_intdigest(name)), list(islice(held, min_docs))
                    yield from ((leaf, h, named, name, [] if k else few) for k, h in enumerate(hashes))

    fields = [("line", pa.int64()), ("template", pa.string())] if last else [("leaf", pa.int64()), ("line", pa.int64()), ("named", pa.int64()), ("masked", pa.string()), ("keys", pa.list_(pa.binary()))]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, masked, keys, rows = None, [], [], []
        for batch in batches:
            for leaf, part, line, own in zip(*(batch.column(c).to_pylist() for c in ("leaf", "part", "masked", "keys"))):
                if at != (leaf, part):
                    if masked:
                        rows += parsed(at[0], masked, keys)
                    at, masked, keys = (leaf, part), [], []
                masked.append(line)
                keys.append(own)
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        if masked:
            rows += parsed(at[0], masked, keys)
        if rows:
            yield batch_of(rows)

    return run


def recurring(keyed: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """keyed: (key, text). (line, template): hashes of masked lines whose template recurs.

    Leaves that have not even min_docs keys together, nearly all, go first. The lines of a leaf are parsed in PARTS
    parts, so that a leaf of any number of lines is many tasks' work, and then the templates of the parts.
    """
    since = made()
    counted = stored(keyed.mapInArrow(trimmed(_count(min_docs, min_tokens)), "leaf long, line long, masked string, keys array<binary>"), "lines")
    likely = counted.groupBy("leaf").agg(F.sum(F.size("keys")).alias("n")).where(F.col("n") >= min_docs).select("leaf")
    lines = counted.join(if_small(stored(likely, "leaves")), "leaf").withColumn("part", F.pmod("line", F.lit(PARTS)))
    dealt = lines.repartition("leaf", "part").sortWithinPartitions("leaf", "part")
    parsed = stored(dealt.mapInArrow(trimmed(_generalise(min_docs, False)), "leaf long, line long, named long, masked string, keys array<binary>"), "parsed")
    met = parsed.where(F.size("keys") > 0).select("leaf", F.lit(0).alias("part"), "masked", "keys").repartition("leaf").sortWithinPartitions("leaf")
    found = stored(met.mapInArrow(trimmed(_generalise(min_docs, True)), "line long, template string").dropDuplicates(["line"]), "found")
    named = parsed.select("line", "named").distinct()
    out = settled(named.join(if_small(found.withColumnRenamed("line", "named")), "named").select("line", "template").dropDuplicates(["line"]), "templates", since)
    free_shuffles(keyed.sparkSession)
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, line, words, all words) of each line of a text that may recur."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for part in slices(batch):
            rows = []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                lines = [mask(x) for x in (text or "").split("\n")]
                total = sum(map(len, lines))
                rows += [(key, i, _signed(xxh64_intdigest(" ".join(t))), len(t), total) for i, t in enumerate(lines) if t]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (part.schema.field("key").type, pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "place", "line", "words", "total"])


def dropped_lines(keyed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, places, templates): of each text that loses lines, their numbers from 0 and, in the same order, templates."""
    since = made()
    lines = recurring(keyed, min_docs)
    each = keyed.mapInArrow(trimmed(_number), "key binary, place int, line long, words int, total int")
    hit = stored(each.join(if_small(lines), "line").dropDuplicates(["key", "place"]), "hit")
    # near copies are sought among texts with such lines only: others count for no template
    before = made()
    having = stored(hit.select("key").distinct(), "having")
    nodes, groups = near_duplicates(stored(keyed.select("key", "text").join(if_small(having), "key").dropDuplicates(["key"]), "texts"))
    of = settled(nodes.join(groups, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "groups", before)
    apart = hit.select("key", "template").distinct().join(if_small(of), "key").select("template", "root").distinct()
    wide = stored(apart.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template"), "wide")
    hit = hit.join(if_small(wide), "template")
    per = hit.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "template"))).alias("cut"), F.sum("words").alias("words"), F.max("total").alias("total"))
    few = per.where(F.col("words") < F.col("total"))
    out = settled(few.select("key", F.col("cut.place").alias("places"), F.col("cut.template").alias("templates")), "dropped", since)
    free_shuffles(keyed.sparkSession)
    return out


def cleaned(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with recurring lines cut from text, and n_chars, if docs has it, counted anew. All rows and columns stay.

    Null and empty texts stay as they are; repeated rows are cut alike; an empty table stays empty. Other columns may
    have any names.
    """
    key, places, of = (free_name(docs, c) for c in ("_key", "_places", "_of"))
    keyed = docs.withColumn(key, text_key("text"))
    cut = dropped_lines(keyed.select(F.col(key).alias("key"), "text"), min_docs).select(F.col("key").alias(of), F.col("places").alias(places))
    joined = keyed.join(if_small(cut), F.col(key) == F.col(of), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(places, i)), "\n")
    out = joined.withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(places).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of lines, of those dropped, their numbers from 0 and, in turn, their templates.

    Null and empty texts have one empty line and lose none; copies and repeated rows lose the same lines; null doc_ids
    stay; an empty table gives no rows. Other columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", text_key("text").alias("key"))
    cut = dropped_lines(docs.select("key", "text"))
    joined = docs.join(if_small(cut.withColumnRenamed("key", "of")), F.col("key") == F.col("of"), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return joined.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("places").cast("array<string>"), ","), F.lit("")).alias("dropped"),
        F.coalesce(F.array_join("templates", "\n"), F.lit("")).alias("templates"),
    )
