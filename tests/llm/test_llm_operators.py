"""Each operator against brute force on a small table with nulls, empty texts, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from twinset.llm import html, lines, mixing, neighbours, packing, quality, sharding, simhash, substring, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, node string, size int"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    plain = [words(rng, rng.randint(1, 400)) for _ in range(60)]
    near = plain[7].split() if len(plain[7].split()) > 80 else words(rng, 300).split()
    near = [w if i % 97 else "changed" for i, w in enumerate(near)]
    passage = words(rng, 60)
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i, t in enumerate(plain)]
    out += [(100 + i, plain[5], "en", "a") for i in range(4)]
    out += [(110, " ".join(near), "en", "a"), (111, "", "en", "b"), (112, None, None, None), (None, plain[9], "en", "a"), (None, None, "en", "a")]
    out += [(120, words(rng, 30) + " " + passage + " " + words(rng, 40), "en", "b"), (121, words(rng, 70) + "\n" + passage + "\n" + words(rng, 9), "en", "b")]
    out += [(130, "x " * 40 + "y", "en", "a"), (130, "x " * 40 + "y", "en", "a"), (131, words(rng, 3000), "de", "b")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", "n", 1) for i, t, lang, s in texts], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_is_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cursor = con.execute(quality.OP5_SQL)
    names = [d[0] for d in cursor.description]
    got = quality.op5_quality_rules(spark, DATA)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def test_quality_edges(docs, nothing, texts):
    rows = quality.quality(docs).collect()
    assert len(rows) == len(texts) and quality.quality(nothing).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[111]["n_words"] == 0 and by[111]["base_failed"] and not by[111]["kept"]
    assert by[130]["n_repeat_words"] == 40 and by[130]["base_failed"]
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)


def test_shards(docs, nothing, texts):
    rows = sharding.assign(docs, [1.0] * 16, [1.0] * 17).collect()
    assert len(rows) == len(texts) and sharding.assign(nothing, [1.0] * 2).count() == 0
    for shard in range(16):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    draw = lambda k, i: (int(hashlib.md5(f"{'null' if k is None else k}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    assert all(r["shard"] == max(range(16), key=lambda i, k=r["doc_id"]: draw(k, i)) for r in rows)
    expected = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in texts)
    assert expected == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)


def test_weights_and_removal(spark):
    keys = spark.range(4000)
    share = {r["s"]: r["count"] for r in keys.select(sharding.rendezvous(keys["id"], [3.0, 1.0, 0.0]).alias("s")).groupBy("s").count().collect()}
    assert share.keys() == {0, 1} and 2700 < share[0] < 3300


def test_packing(docs, nothing, texts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    rows = packing.pack_documents(docs, path, 256, 2, ids_too=True).collect()
    assert packing.pack_documents(nothing, path).count() == 0
    expected = collections.Counter((i, tuple(model.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in texts)
    pieces = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 256
        pieces[r["sequence_id"]].append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    whole = [(i, ids) for (i, ids), n in expected.items() for _ in range(n)]
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in whole)
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(i for i, _ in whole)
    assert len(pieces) <= -(-sum(r["length"] for r in rows) // 256) + 2
    sequences = packing.sequences(packing.pack_documents(docs, path, 256, 2, ids_too=True))
    assert sequences.count() == len(pieces)


def test_local_search_empties_bins():
    start = collections.Counter({((6, 1), (3, 1)): 1, ((5, 1),): 1, ((4, 1), (2, 1)): 1})
    out = packing.local_search(start, 10)
    assert sum(out.values()) == 2 and sum(k * v * n for p, n in out.items() for k, v in p) == 20
    rng = random.Random(1)
    counts = collections.Counter(rng.randint(1, 100) for _ in range(5000))
    packed = packing.pack(dict(counts), 100)
    assert collections.Counter({k: sum(v * n for p, n in packed.items() for x, v in p if x == k) for k in counts}) == counts
    assert all(sum(k * v for k, v in p) <= 100 for p in packed)
    # large items, few to a bin: within 1 % of the sum of lengths, and no worse than best fit alone
    assert sum(packed.values()) <= 1.01 * sum(k * n for k, n in counts.items()) / 100
    assert sum(packed.values()) <= sum(packing.best_fit(dict(counts), 100).values())


def test_chunks_are_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    encode = packing.encoder(path, chunks=3)
    rows = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    for t in [*rows, "", " ", "a  b", " a", "b ", "a \n b", "x\n", "<|endoftext|> y", "\xa0 z", "it's a", "　 w", "é \U0001f600"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids, t


def test_near_fingerprints(spark, nothing):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(3):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ sum(1 << rng.randrange(24) for _ in range(k % 3)) & (2**64 - 1) for k in range(300)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2).collect()
    parent = {x: x for x in signed}

    def find(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for e in edges:
        a, b = find(parent, e["u"]), find(parent, e["v"])
        parent[max(a, b)] = min(a, b)
    brute = {x: x for x in signed}
    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= 2:
                a, b = find(brute, signed[i]), find(brute, signed[j])
                brute[max(a, b)] = min(a, b)
    assert {x: find(parent, x) for x in signed} == {x: find(brute, x) for x in signed}
    assert simhash.linked_groups(nothing).count() == 0


def test_fingerprints_and_groups(docs, texts):
    def brute(text):
        ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [b" ".join(ws)] if ws else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = simhash.linked_groups(docs).collect()
    assert len(rows) == len(texts)
    expected = collections.Counter((i, brute(t)) for i, t, *_ in texts)
    assert expected == collections.Counter((r["doc_id"], r["f0"] % 2**64) for r in rows)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert {by[100 + i] for i in range(4)} == {5} and by[111] == by[112] == 111


def test_one_of_each_near_group_stays(docs, nothing, texts):
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[130] == 1 and ids[5] == 1 and not any(ids[100 + i] for i in range(4))
    assert ids[111] + ids[112] + (ids[None] > 0) == 1 and ids[9] == 1
    assert all(ids[i] for i in (0, 1, 2, 120, 121, 131))
    assert simhash.deduplicated(nothing).count() == 0


def test_lines(spark, nothing):
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 12)}\nPosted on {i} by user {i * 7} in news\n{words(rng, 9)}\nAll rights reserved here", 0) for i in range(30)]
    same = words(rng, 20) + "\n" + words(rng, 20)
    rows += [(100 + i, same + "\n" + words(rng, 1), 0) for i in range(12)] + [(200, None, 0), (201, "", 0), (202, "All rights reserved here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in lines.cleaned(docs).collect()}
    assert len(out) == len(rows) and lines.cleaned(nothing).count() == 0
    for i, text, _ in rows[:30]:
        parts = text.split("\n")
        assert out[i]["text"] == f"{parts[0]}\n{parts[2]}" and out[i]["n_chars"] == len(out[i]["text"])
    assert all(out[100 + i]["text"] == rows[30 + i][1] for i in range(12))  # copies of each other stay whole
    assert out[200]["text"] is None and out[201]["text"] == "" and out[202]["text"] == "All rights reserved here"
    found = lines.templates([(tuple(t.split()), set()) for t in ("a b c d e", "a b c d f", "a x y z w")])
    assert [" ".join(t) for t, _ in found] == ["a b c d <*>", "a x y z w"]


def test_passages(docs, nothing):
    rows = substring.duplicated(docs).collect()
    assert substring.duplicated(nothing).count() == 0
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["start"], r["end"], r["removed"], r["cluster_id"]))
    assert {120, 121, 5, 100, 101, 102, 103} <= got.keys()
    (a,), (b,) = got[120], got[121]
    assert (a[0] <= 30 and a[1] >= 90 and b[0] <= 70 and b[1] >= 130) and a[2] != b[2] and a[3] == b[3] == 120
    assert all(x[2] for i in range(4) for x in got[100 + i]) and not any(x[2] for x in got[5] if x[1] - x[0] > 400)
    assert not {0, 1, 2, 131, 111, 112} & got.keys()
    assert substring.repeats(np.arange(200, dtype=np.uint32), np.arange(60, 150, dtype=np.uint32), 60) == [(60, 150)]


def test_warc(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"http://www.h{i % 5}.org/p/{i % 7}?q=é {i}", words(rng, 30)) for i in range(40)]
    rows += [(50 + i, None, "same") for i in range(5)] + [(60, "x", None), (61, "y", ""), (None, "z", "alone"), (70, "http://[", "bad"), (70, "http://[", "bad")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, warc string").repartition(4)
    from pyspark.sql import functions as F

    folder = f"file://{tmp_path}/w"
    manifest, parts = warc.archive(pages, folder, F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0))))
    out = warc.read_archives(spark, folder, manifest).collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    expected = collections.Counter()
    for i, _, h in rows:
        top = last[h or ""]
        one = i == top or (i is None and top == -1)
        data = (h or "").encode()
        expected[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if one else "revisit", None if one else top] += 1
    assert expected == collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    history = warc.read_history(spark, folder, parts).orderBy("history_part", "history_line").collect()
    keys = [f"{r['url_key']} {r['timestamp']}" for r in history]
    assert len(keys) == len(rows) and keys == sorted(keys)
    runs = [(r["run"], r["lines"], r["bounds"]) for r in manifest.collect()]
    again = warc.merge_runs(spark, folder, runs, fan_in=2, lines_per_range=9)
    more = warc.read_history(spark, folder, again).orderBy("history_part", "history_line").collect()
    assert [(r["url_key"], r["timestamp"], r["warc"], r["offset"]) for r in more] == [(r["url_key"], r["timestamp"], r["warc"], r["offset"]) for r in history]
    none = warc.archive(pages.limit(0), f"file://{tmp_path}/e", F.current_timestamp())
    assert none[0].count() == 0 and none[1] == []


def test_loser_tree():
    rng = random.Random(8)
    for k in range(9):
        runs = [sorted(rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(0, 6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(sum(runs, []))


def test_neighbours(spark):
    rows = [(r[0], r[1]) for r in duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY 1").fetchall()]
    dim = len(rows[0][1])
    good = dict(rows)
    odd = [(1001, None), (1002, [0.0] * dim), (1003, [float("nan")] * dim), (1020, [None] * dim), (1005, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    found = collections.defaultdict(list)
    for r in neighbours.search(df, lambda i: i % 20 == 0, 20).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids, x = np.array(list(good)), np.array(list(good.values()))
    hits = total = 0
    for q in (i for i in good if i % 20 == 0):
        own = sorted(found[q])
        assert [o[0] for o in own] == list(range(1, 21)) and q not in [o[1] for o in own]
        score = x @ np.array(good[q])
        assert all(abs(s - score[list(ids).index(v)]) < 1e-12 for _, v, s in own)
        assert own == [own[k] for k in np.lexsort(([o[1] for o in own], [-o[2] for o in own]))]
        best = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        hits, total = hits + len({o[1] for o in own} & set(best)), total + 20
    assert hits >= 0.9 * total and found.keys() == {i for i in good if i % 20 == 0}
    assert neighbours.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_mixing(docs, nothing, texts):
    rows = mixing.mix(docs, [5.0, 2.0, 1.0]).collect()
    assert len(rows) == len(texts) and mixing.mix(nothing, [1.0]).count() == 0
    sizes = collections.Counter()
    for _, t, _, s in texts:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 3 * sizes[s] if s in capped else weight[s] * level for s in sizes}
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * total
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 60 for s in sizes)
    again = mixing.mix(docs.repartition(5), [5.0, 2.0, 1.0]).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["copies"])
    assert [(r["doc_id"], r["copies"]) for r in sorted(again, key=key)] == [(r["doc_id"], r["copies"]) for r in sorted(rows, key=key)]
    mixed = mixing.mixed_documents(docs, [5.0, 2.0, 1.0])
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header>Site {n}</header><nav><ul><li><a href=1>one</a><li><a href=2>two</a></ul></nav>
<article><h1>Head &amp; {n}</h1><p>First <b>bold</b>  text {n}<br>more<p>Second<script>var a="</article><p>no";</script><aside>aside</aside></article>
<div class="comments"><p>reader {n}</p></div><form>form</form><footer>&copy; end</footer></body></html>"""


def test_pages(spark):
    plain = "<html><body><div class=menu>m</div><div id='content'><p>Just {n}</p></div><div class='sidebar-left'>s</div></body></html>"
    bare = "<body><p>Fixed line of the site</p><p>Own text {n}</p><ul><li><a href=x>a {n}</a></li></ul></body>"
    rows = [(i, "http://a.org/x", PAGE.format(n=i)) for i in range(6)] + [(10 + i, "https://b.org:80/", plain.format(n=i)) for i in range(4)] + [(20 + i, None, bare.format(n=i)) for i in range(4)]
    rows += [(30, "http://a.org/", None), (31, "http://a.org/", ""), (None, "c", "<p>x"), (32, "http://d.org", "<p>" + "long " * 50000)]
    df = spark.createDataFrame([(*r, "r") for r in rows], "page_id long, url string, html string, rule string").repartition(3)
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert len(got) == len(rows) and html.extract(df.limit(0)).count() == 0
    assert all(got[i]["text"] == f"Head & {i}\nFirst bold text {i} more\nSecond" for i in range(6))
    assert all(got[10 + i]["text"] == f"Just {i}" and got[20 + i]["text"] == f"Own text {i}" for i in range(4))
    assert got[30]["text"] == got[31]["text"] == "" and got[None]["text"] == "x" and got[32]["n_chars"] == 5 * 50000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_wrapper_is_a_regular_expression_without_unions():
    trees = [html.page_tree(p) for p in ("<ul><li>a<li>b</ul><p>x", "<ul><li>c</ul><p>x<h2>h</h2>")]
    html.merge(trees[0], trees[1])
    assert html.expression(trees[0]) == "<ul>(<li>#text</>)+</><p>#fixed</>(<h2>#fixed</>)?"


def texts_of(pages):
    trees = [html.page_tree(p) for p in pages]
    for t in trees[1:]:
        html.merge(trees[0], t)
    rule = html.rule_of(trees[0])
    return [html.main_text(p, rule) for p in pages]


def test_names_do_not_hide_main_text():
    page = """<html class="no-cookies"><body class="has-sidebar"><div class="layout header-fixed"><div class="sidebar">s {n}</div><article class="post with-sidebar comments-open"><p>Own {n} <a class="popup" href=x>word</a></p>
    <section id="side-effects"><p>Nausea {n}</p></section><section id="discussion"><p>We find {n}</p></section><h2 id="Related_work">Related {n}</h2>
    <div class="comments-area">reader {n}</div><div class="ad">buy {n}</div></article></div></body></html>"""
    assert texts_of([page.format(n=n) for n in range(4)]) == [f"Own {n} word\nNausea {n}\nWe find {n}\nRelated {n}" for n in range(4)]
    plain = "<body class='has-sidebar'><div id=content class=no-sidebar><p>Own {n}</p></div><div class=sidebar-left>s</div></body>"
    assert texts_of([plain.format(n=n) for n in range(4)]) == [f"Own {n}" for n in range(4)]
    bare = "<body><div class='page no-sidebar'><p>Own {n}</p><div class=menu>m {n}</div></div></body>"
    assert texts_of([bare.format(n=n) for n in range(4)]) == [f"Own {n}" for n in range(4)]


def test_leaves_of_any_size_have_one_rule():
    rng = random.Random(9)
    names = [f"This story was written by {words(rng, 1)}{a} {words(rng, 1)}{b} in Rome" for a in "klmnopqrstuvwxyz" for b in "klmnopqrstuvwxyzijä"]
    (only,) = lines.templates([(tuple(t.split()), set()) for t in sorted(names)])
    assert " ".join(only[0]) == "This story was written by <*> <*> in Rome" and len(only[1]) == len(names) > 300
    mixed = sorted({tuple(rng.choices(["a", "b", "<*>"], [8, 2, 1], k=n)) for n in [9] * 900})
    expected = []
    for i, tokens in enumerate(mixed):
        for template, own in expected:
            equal = [a for a, b in zip(template, tokens) if a == b]
            if len(equal) >= 0.75 * 9 and 2 * sum(a != "<*>" for a in equal) >= 9:
                template[:] = [a if a == b else "<*>" for a, b in zip(template, tokens)]
                own.append(i)
                break
        else:
            expected.append((list(tokens), [i]))
    assert lines.templates([(t, set()) for t in mixed]) == expected and 300 < len(mixed)


def test_near_texts_are_found_whatever_the_change(spark):
    rng = random.Random(12)
    vocabulary = words(rng, 3000).split()
    rows = []
    while len(rows) < 300:
        own = rng.choices(vocabulary, k=rng.randint(60, 400))
        n = len(own)
        new = rng.choices(vocabulary, k=n)
        change = [own + new[: n * 22 // 100], own[: -(n // 11)] + new[: n // 11], [new[i] if i % 45 == 7 else w for i, w in enumerate(own)]][len(rows) // 2 % 3]
        x, y = (set(simhash.shingles(" ".join(t), 5)) for t in (own, change))
        if 0.8 <= len(x & y) / len(x | y) < 0.84:
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(change))]
    rows += [(1000, ""), (1001, "  ")]
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert kept == {*range(0, 300, 2), 1000}


def test_lines_recur_outside_near_copies(spark):
    rng = random.Random(13)
    license, shared = "This text stands under the usual license of our site", words(rng, 60) + "\n" + words(rng, 60)
    rows = [(i, f"{words(rng, 4)}\n{license}") for i in range(12)]
    rows += [(100 + i, f"{shared}\n{license}\n{words(rng, 1)}") for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == text.replace(f"\n{license}", "") for i, text in rows)


def test_short_lines_recur_as_they_stand(spark):
    rng = random.Random(14)
    rows = [(i, f"{words(rng, 30)}\nRead more\n{words(rng, 9)}\nLes.\nPart {i}\n\n{words(rng, 5)}") for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in lines.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == text.replace("\nRead more", "").replace("\nLes.", "") for i, text in rows)


def test_scripts_end_at_their_own_end_tag():
    page = """<body><article><p>One {n}</p><script>for(i=0;i<n;i++)a(i)</script><p>Two</p><script>s="<!--";if(i<e.length)b('"')</SCRIPT
    ><style>a<b{{}}</style><svg/><p>Three <svg><path d='1'/></svg>{n}</p></article><script>x<y"</body>"""
    assert texts_of([page.format(n=n) for n in range(4)]) == [f"One {n}\nTwo\nThree {n}" for n in range(4)]
