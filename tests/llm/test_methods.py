"""The operators' methods against brute force, and the pipeline's stages on rows that are not as they should be."""

import collections
import math
import os
import random
import subprocess
import sys
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinset.llm import common, html, lines, mixing, neighbours, packing, registry, simhash, substring
from twinset.llm.common import text_key


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n)]


def text(rng, n):
    return " ".join(words(rng, n))


def edited(rng, own, kinds):
    out = list(own)
    for kind in kinds:
        at = rng.randrange(len(out))
        if kind == "put in":
            out.insert(at, "new" + str(rng.random()))
        elif kind == "left out":
            del out[at]
        else:
            out[at] = "other" + str(rng.random())
    return out


def paragraphs(a, b):
    """Pairs of 50-word windows with Jaccard similarity >= 0.8 of five-word shingles."""
    sets = [[frozenset(tuple(x[k : k + 5]) for k in range(i, i + 46)) for i in range(len(x) - 49)] for x in (a, b)]
    return [(i, j) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]) if len(x & y) >= 0.8 * len(x | y)]


def test_repeats_are_those_of_brute_force():
    rng = random.Random(21)
    for _ in range(60):
        a = [rng.randrange(400) for _ in range(rng.randint(50, 110))]
        b = [rng.randrange(400) for _ in range(rng.randint(0, 9))] + edited(rng, a, [rng.choice(["put in", "left out", "changed"]) for _ in range(rng.randint(0, 2))])
        numbers = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
        x, y = (np.array([numbers[w] for w in t], dtype=np.uint32) for t in (a, b))
        want, near = set(), paragraphs(a, b)
        diagonals = {i - j for i, j in near}
        for i, _ in near:
            want |= set(range(i, i + 50))
        got = {k for d in diagonals for s, e in substring.repeats(x, y, d) for k in range(s, e)}
        assert got == want


@pytest.mark.parametrize("kind", ["put in", "left out", "changed"])
def test_paragraphs_with_a_change_are_found(spark, kind):
    rng = random.Random(22)
    pairs = []
    for _ in range(120):
        own = words(rng, rng.randint(50, 70))
        a, b = words(rng, 30) + own + words(rng, 20), words(rng, 9) + edited(rng, own, [kind]) + words(rng, 40)
        if paragraphs(a, b):
            pairs.append((a, b))
    rows = [(2 * i + k, " ".join(t)) for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    found = {r["doc_id"] for r in substring.duplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(2 * i in found and 2 * i + 1 in found for i in range(len(pairs))) >= 0.95 * len(pairs) and len(pairs) > 50


def test_texts_that_their_least_text_does_not_link(spark):
    rng = random.Random(23)
    rows = []
    for k in range(30):
        own = words(rng, 60)
        for n, at in enumerate((22, None, 37)):
            rows.append((3 * k + n, " ".join(words(rng, 20) + [w if i != at else "other" for i, w in enumerate(own)] + words(rng, 20))))
    got = substring.duplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["doc_id"] for r in got}) >= 0.97 * len(rows)


@pytest.mark.parametrize("kind", ["put in", "left out", "changed"])
def test_near_paragraphs_around_common_runs_are_found(spark, kind):
    rng = random.Random(25)
    before, after, rows = words(rng, 20), words(rng, 24), []
    for k in range(60):
        own = before + words(rng, 7) + after
        other = list(own)
        other[20 : 20 + (kind != "put in")] = [] if kind == "left out" else ["new"]
        rows += [(2 * k, " ".join(words(rng, 20) + own + words(rng, 20))), (2 * k + 1, " ".join(words(rng, 9) + other + words(rng, 30)))]
    got = substring.duplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    of = {r["doc_id"]: r["cluster_id"] for r in got}
    assert sum(of.get(2 * k) == of.get(2 * k + 1) == 2 * k for k in range(60)) >= 57


def test_signatures_meet_where_paragraphs_repeat():
    rng = random.Random(26)
    met = 0
    for _ in range(40):
        a = words(rng, rng.randint(50, 60))
        b = edited(rng, a, [rng.choice(["put in", "left out", "changed"])])
        near = paragraphs(a, b)
        numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys([*a, *b]))}
        x, y = (np.array([numbers[w] for w in t], dtype=np.uint64) for t in (a, b))
        every = lambda t: np.arange(len(t))
        hashes = [set(substring.signatures(t, every(t), np.ones(len(t), bool))[0].tolist()) for t in (x, y)]
        met += bool(near)
        assert not near or hashes[0] & hashes[1]
    assert met > 20


def test_anchors_that_meet_all_others_have_no_signatures():
    rng = random.Random(27)
    line, own = words(rng, 20), words(rng, 120)
    texts = [" ".join(line * 5), " ".join(own), " ".join(line * 5 + own)]
    at, half = [[30], [40], [30, 140]], [list(range(77)), list(range(97)), list(range(197))]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(at), pa.array(half), pa.array(texts)], names=["node", "at", "half", "text"])
    rows = [r for out in substring._signatures(iter([batch])) for r in out.to_pylist()]
    assert {r["node"] for r in rows} == {2, 3} and {r["h"] for r in rows if r["node"] == 2} == {r["h"] for r in rows if r["node"] == 3}
    marked = [r for out in substring._halves(iter([batch.select(["node", "at", "text"])])) for r in out.to_pylist() if r["odd"]]
    assert [(r["node"], r["s"]) for r in marked] == [(1, 30), (3, 30)]


def test_runs_of_one_word_meet_without_pairing_their_places(spark):
    rng = random.Random(28)
    rows = [(i, " ".join(words(rng, 30) + ["the"] * (150 + i) + ["of"] * 60 + words(rng, 30))) for i in range(24)]
    at = substring.made()
    got = substring.duplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    tables = {path.rsplit("-", 1)[1]: path for _, path in common._made[at:]}
    assert spark.read.parquet(tables["others"]).count() < 20_000
    removed = collections.defaultdict(set)
    for r in got:
        if r["removed"]:
            removed[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert {r["doc_id"] for r in got} == set(range(24)) and {r["cluster_id"] for r in got} == {0}
    assert len(removed) == 23 and all(set(range(30, 240 + i)) <= removed[i] for i in removed)


@pytest.mark.parametrize("similar", [0.8, 0.9])
def test_rare_shingles_meet_where_paragraphs_repeat(similar):
    rng = random.Random(29)
    met = 0
    for _ in range(60):
        line = [rng.randrange(30) for _ in range(rng.randint(8, 20))]
        a = (line * 9)[: rng.randint(52, 70)]
        b = edited(rng, a, [rng.choice(["put in", "left out", "changed"])])
        numbers = {w: i + 1 for i, w in enumerate(dict.fromkeys([*a, *b]))}
        x, y = (np.array([numbers[w] for w in t], dtype=np.uint64) for t in (a, b))
        grams = [substring.runs(t, 5) for t in (x, y)]
        counts = collections.Counter(np.concatenate(grams).tolist())
        found = []
        for g, t in zip(grams, (x, y)):
            s, p = substring.prefixes(g, np.array([counts[k] for k in g.tolist()]), np.arange(len(t) - 49), similar)
            found.append({i: set(zip(g[p[s == i]].tolist(), (p[s == i] - i).tolist())) for i in range(len(t) - 49)})
        for d in range(-3, 4):
            for lo, hi in substring.repeats(x.astype(np.uint32), y.astype(np.uint32), d, similar):
                for i in range(lo, hi - 49):
                    if substring.repeats(x[i : i + 50].astype(np.uint32), y[i - d : i - d + 50].astype(np.uint32), 0, similar):
                        met += 1
                        assert any(h == k and abs(p - q) <= 1 for h, p in found[0][i] for k, q in found[1][i - d])
    assert met > 20


def test_cut_passages(spark):
    rng = random.Random(24)
    own = text(rng, 80)
    rows = [(1, f"a b c\n{own}\nd", "x"), (None, f"e f {own}", "y"), (3, None, "z"), (4, "", "z"), (5, text(rng, 90), "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["spans"]: r["text"] for r in substring.without_repeats(docs).where("spans <> 'z'").collect()}
    whole = [k for k, t in (("x", rows[0][1]), ("y", rows[1][1])) if out[k] == t]
    assert len(whole) == 1 and out["w"] == rows[4][1] and len(out["y" if whole == ["x"] else "x"].split()) < 20
    assert substring.without_repeats(docs.limit(0)).count() == 0


def groups_of(texts):
    """Components by brute force over five-word Jaccard similarity >= 0.8."""
    sets = [frozenset(simhash.hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {frozenset(i for i in range(len(texts)) if find(i) == r) for r in set(map(find, range(len(texts))))}


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = random.Random(25)
    base, texts = words(rng, 150), []
    for _ in range(150):  # one large group of looser and closer copies
        texts.append(" ".join(edited(rng, base, ["changed"] * rng.choice([0, 1, 2, 4, 8, 12]))))
    for _ in range(40):
        own = words(rng, rng.randint(1, 200))
        more = rng.choice([own + words(rng, len(own) // 5), own[: max(1, len(own) * 5 // 6)], edited(rng, own, ["put in", "left out"])])
        texts += [" ".join(own), " ".join(more)]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4).withColumn("key", text_key("text")).persist()
    nodes, groups = simhash.near_duplicates(docs.select("key", "text"))
    found = {}
    for r in docs.join(nodes, "key").join(groups, "node", "left").select("i", "node", "root").collect():
        found.setdefault(r["node"] if r["root"] is None else r["root"], set()).add(r["i"])
    assert {frozenset(g) for g in found.values()} == groups_of(texts)


def test_prefixes_meet_whatever_the_counts():
    rng, near = np.random.default_rng(28), 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 2**63, rng.integers(0, 5)).astype(np.uint64)]))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            near += 1
            known = np.sort(np.union1d(a, b)[rng.random(len(np.union1d(a, b))) < 0.5])
            for counts in ((known, rng.integers(4, 9, len(known))), (known[:0], np.zeros(0, np.int64))):
                assert len(np.intersect1d(simhash.prefix(a, counts, 0.8), simhash.prefix(b, counts, 0.8)))
    assert near > 100


def test_parities_never_overstate():
    rng = random.Random(26)
    for _ in range(200):
        x, y = ({rng.getrandbits(64) for _ in range(rng.randint(0, 300))} for _ in "xy")
        y |= set(rng.sample(sorted(x), len(x) // 2))
        bits = [np.unpackbits(np.frombuffer(simhash.parities(np.array(sorted(s), dtype=np.uint64)), np.uint8)) for s in (x, y)]
        assert (bits[0] != bits[1]).sum() <= len(x ^ y)


def test_lines_of_near_copies_count_once_however_they_differ(spark):
    rng = random.Random(27)
    line, rows = "This text stands under the usual license of our site", []
    for k in range(9):
        own = words(rng, 200)
        rows += [(2 * k, f"{' '.join(own)}\n{line}"), (2 * k + 1, f"{text(rng, 20)} {' '.join(own[20:])}\n{line}")]
    assert len(set(groups_of([t for _, t in rows]))) == 9
    out = {r["doc_id"]: r["text"] for r in lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == dict(rows)


def test_templates_are_those_of_a_plain_search():
    rng = random.Random(27)

    def plain(rows):
        found = []
        for i, tokens in enumerate(rows):
            for template, own in found:
                same = sum(a == b for a, b in zip(template, tokens))
                constant = sum(a == b != "<*>" for a, b in zip(template, tokens))
                if same >= lines.SIMILAR * len(tokens) and 2 * constant >= len(tokens):
                    template[:] = [a if a == b else "<*>" for a, b in zip(template, tokens)]
                    own.append(i)
                    break
            else:
                found.append((list(tokens), [i]))
        return found

    for n in (3, 4, 8, 13):
        rows = sorted({tuple(rng.choice("ab" if rng.random() < 0.8 else "cdefgh") for _ in range(n)) for _ in range(250)})
        assert lines.templates([(r, set()) for r in rows]) == plain(rows)


def test_wrappers_tell_the_main_text():
    rng = random.Random(28)

    def of(pages):
        tree = html.page_tree(pages[0])
        for page in pages[1:]:
            html.merge(tree, html.page_tree(page))
        return [html.main_text(p, html.rule_of(tree)) for p in pages]

    own = [[text(rng, n) for n in (4, 40, 30, 1, 3)] for _ in range(5)]
    one = [f"<body><div class=qa>Site of things</div><div class=qb>{d}</div><div class=qc><h1>{a}</h1><p>{b}</p><p>{c}</p></div><div class=qd>{e}</div>" for a, b, c, d, e in own]
    two = [f"<body><div class=qd><h1>{a}</h1><p>{b}</p><p>{c}</p></div><div class=qc>{d}</div><div class=qa>{e}</div>Fixed end" for a, b, c, d, e in own]
    assert of(one) == of(two) == ["\n".join(x[:3]) for x in own]
    noticed = [f"<main><h2>Method</h2><div>The same notice on all pages</div><p>{x[1]}</p></main>" for x in own]
    assert of(noticed) == [f"Method\n{x[1]}" for x in own]
    assert of(["<main><p>all alike</p></main>"] * 4) == ["all alike"] * 4
    assert of([f"{'<div>' * 100}<article>in {x[3]}</article>{'</div>' * 100}<p>other {x[4]}" for x in own]) == [f"in {x[3]}" for x in own]
    marked = "<html class='no-cookies'><body class='single post has-sidebar'><div class='page-with-sidebar'><article class='post comments-open'><p>{}</p></article></div>"
    assert of([marked.format(x[1]) for x in own]) == [x[1] for x in own]


def test_common_rows():
    rng = random.Random(29)
    for table in (10**6, -1):
        for _ in range(200):
            x, y = ([rng.choice("abcdef") for _ in range(rng.randint(0, 12))] for _ in "xy")
            before, html.TABLE = html.TABLE, table
            row = html.common_row(x, y)
            html.TABLE = before
            assert all(x[i] == y[j] for i, j in row) and all(a < c and b < d for (a, b), (c, d) in zip(row, row[1:]))
            if table > 0:
                best = [[0] * 13 for _ in range(13)]
                for i in range(len(x)):
                    for j in range(len(y)):
                        best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
                assert len(row) == best[len(x)][len(y)]


def test_unclosed_tags_and_comments():
    none = {"roots": [], "fixed": {}, "links": []}
    assert [html.main_text(p, none) for p in ("a<!-- b > c", "a <!-- b", "x<![CDATA[ y > z", "1 <!-- c --> 2 <!-- d")] == ["a", "a", "x", "1 2"]
    assert html.main_text("<p>x</p>" + '<a "' * 50_000, none).startswith('x\n<a "')


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _key string, _of string, _id string, _n string, _low string, _high string, _row string, _words string, node string, root string, spans string, copies int"


def test_stages_take_any_rows_and_columns(spark):
    rng = random.Random(30)
    rows = [(i, text(rng, rng.randint(20, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1) for i in range(40)]
    rows += [(1, rows[1][1], "en", "a", 1)] * 2 + [(None, rows[2][1], None, None, None), (None, None, None, None, None), (50, "", "en", "a", 0), (51, "\n\n", "en", "a", 2)]
    rows += [(60 + i, f"{text(rng, 30)}\nThe usual license of our site stands here", "en", "b", 1) for i in range(12)] + [(80, text(rng, 30_000), "de", "b", 1)]
    docs = spark.createDataFrame([(*r, *["x"] * 11, 1) for r in rows], CLASHING).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:4]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, "")
            assert out.columns == docs.columns and (out.count() > 0) == (given is docs), name
    packed = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert len({(r["doc_id"], r["piece"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in packed}) == len(packed) >= len(rows)
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), "").count() == 0
    cleaned = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, "").where("doc_id >= 60").collect()}
    assert all("license" not in cleaned[60 + i] for i in range(12)) and cleaned[80] == rows[-1][1]


def test_mixing_balances_sources_and_sizes(spark):
    rng = random.Random(31)
    rows = []
    for i in range(900):
        source = rng.choice("abbc")
        rows.append((i, " ".join(["w"] * (rng.randint(1, 40) if source == "a" else rng.randint(10, 900))), source))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4), [5.0, 2.0, 1.0]).collect()
    size_class = lambda r: math.floor(math.log2(r["size"] + 1))
    rate = {}
    for r in got:
        assert rate.setdefault((r["source"], size_class(r)), r["rate"]) == r["rate"]
    mass = lambda of: sum(r["size"] * r["rate"] for r in got if of(r))
    for s in "abc":
        target = next(r["target"] for r in got if r["source"] == s)
        assert abs(mass(lambda r: r["source"] == s) - target) <= 1e-6 * target
    full = {s for s in "abc" if all(abs(v - 3) < 1e-9 for (t, _), v in rate.items() if t == s)}
    # between two sources, rates of a class differ by one factor: exponential tilts of source and of class
    for s in set("abc") - full:
        for t in set("abc") - full:
            factors = [rate[s, k] / rate[t, k] for k in range(12) if (s, k) in rate and (t, k) in rate and max(rate[s, k], rate[t, k]) < 3]
            assert not factors or max(factors) - min(factors) <= 1e-6 * max(factors)
    # and sizes are nearer to their shares of all words than with one rate for a source
    words, total, wanted = sum(r["size"] for r in got), mass(lambda r: True), {r["source"]: r["target"] / r["source_size"] for r in got}
    off = lambda rate_of: sum(abs(sum(r["size"] * rate_of(r) for r in got if size_class(r) == b) / total - sum(r["size"] for r in got if size_class(r) == b) / words) for b in range(12))
    assert off(lambda r: r["rate"]) < off(lambda r: wanted[r["source"]])


def test_packed_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_tokenizer())
    model.encode_special_tokens = True
    rng = random.Random(32)
    texts = [text(rng, rng.choice([1, 5, 60, 300, 900, 4000])) for _ in range(60)] + ["", None, "  two  blanks \n\n", "äöü 中文 <|endoftext|> 12345 don't", "x" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(docs, packing.default_tokenizer(), 1024, 2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    bins, total = {}, 0
    for i, t in enumerate(texts):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sum(r["length"] for r in own) == len(ids) and (len(own) == 1 or len(ids) > 1024)
        total += len(ids)
    for parts in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0 and sum(n for _, n in parts) <= 1024
    rooms = []  # first fit, longest first
    for n in sorted((r["length"] for r in rows), reverse=True):
        k = next((k for k, room in enumerate(rooms) if room >= n), None)
        if k is None:
            rooms.append(1024 - n)
        else:
            rooms[k] -= n
    assert -(-total // 1024) <= len(bins) <= len(rooms)


@pytest.mark.parametrize("name", ["op3_sharding", "op7_warc"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


_SAMPLING = """
from pyspark.sql import SparkSession, functions as F
from twinset.llm import neighbours
spark = SparkSession.builder.master("local[4]").config("spark.driver.maxResultSize", "10m").config("spark.ui.enabled", "false").getOrCreate()
spark.conf.set("spark.sql.shuffle.partitions", "4")
rows = spark.range(0, 120000, 1, 12).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.rand(5) + i * F.rand(6)).alias("embedding"))
assert neighbours.search(rows, lambda i: i % 30000 == 0, 5).count() == 20
"""


def test_sampling_sends_the_driver_no_more_than_the_sample():
    subprocess.run([sys.executable, "-c", _SAMPLING], check=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))


def test_sample_has_the_least_hashes(spark):
    rows = spark.range(0, 3000, 1, 7).select((F.col("id") % 2500).alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    want = [r["vec_id"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(100).collect()]
    assert [int(v[0]) % 2500 for v in neighbours.sampled(rows, 3000, 100)] == want
    alike = rows.withColumn("vec_id", F.lit(7).cast("long"))
    assert neighbours.sampled(alike, 3000, 100).shape == (100, 2) and neighbours.sampled(rows, 3000).shape == (3000, 2)


def neighbours_by_all_products(ids, x, asked, k):
    out = {}
    for q in asked:
        score = (x * x[list(ids).index(q)]).sum(1)
        out[q] = [int(ids[i]) for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
    return out


def found_neighbours(spark, ids, x, k=20):
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(list)
    for r in sorted(neighbours.search(rows, lambda i: i % 20 == 0, k).collect()):
        found[r["query_id"]].append(r["vec_id"])
    return found


def test_queries_unlike_the_rows_find_all_neighbours(spark):
    rng = np.random.default_rng(3)
    ids, middles = np.arange(4000), rng.normal(size=(20, 32))
    x = middles[rng.integers(20, size=4000)] + 1e-3 * rng.normal(size=(4000, 32))
    x[::20] = rng.normal(size=(200, 32))
    want = neighbours_by_all_products(ids, x, range(0, 4000, 20), 20)
    found = found_neighbours(spark, ids, x)
    assert sum(len(set(found[q]) & set(own)) for q, own in want.items()) == 200 * 20


def test_equal_vectors_are_neighbours_by_id(spark):
    rng = np.random.default_rng(4)
    ids = rng.permutation(3000)
    x = rng.normal(size=(3000, 8))
    x[rng.random(3000) < 0.5] = x[0]
    assert found_neighbours(spark, ids, x) == neighbours_by_all_products(ids, x, range(0, 3000, 20), 20)


def test_needed_copies():
    rng = random.Random(5)
    for _ in range(50):
        ids = np.array([rng.randrange(8) for _ in range(40)])
        x = np.array([[rng.randrange(2), 1.0] for _ in range(40)])
        kept = neighbours.needed_copies(x, ids, 3)
        for own in range(9):
            for value in (0, 1):
                every = sorted(ids[(ids != own) & (x[:, 0] == value)])[:3]
                assert sorted(ids[kept][(ids[kept] != own) & (x[kept][:, 0] == value)])[:3] == every


def test_queries_are_copied_to_shards_and_not_to_lists():
    x = np.random.default_rng(6).normal(size=(4000, 16)).astype(np.float32)
    model = neighbours.Model(x.astype(np.float64), 4000)
    lists = neighbours._nearest(x.astype(np.float64), model.centroids)
    held = [{"list": int(j), "n": int((lists == j).sum()), "far": 9.0, "norm": 9.0} for j in np.unique(lists)]
    shards = neighbours.Shards(model, held, 1024)
    asked = pd.DataFrame({"vec_id": range(50), "vector": [v.tobytes() for v in x[:50]], "least": [None] * 50})
    rows = pd.concat(neighbours._route(model, shards, np.float32, True)([asked]))
    assert model.lists > 60 and shards.count < 10 and len(rows) == 50 * shards.count and not rows.duplicated(["shard", "vec_id"]).any()
