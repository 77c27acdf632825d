"""Directory matching against a recursive fold over random trees, and scenarios with fixed results."""

import random

from twinset.functions.rule import FLAGS, MatchRule
from twinset.operators import analyze
from twinset.sources.catalog import catalog_of

META = ["mtime_ns", "atime_ns", "ctime_ns", "mode", "uid", "gid"]


def tree(rng, top, other=None):
    """Random nodes below top, some of them taken over from another tree's places."""
    nodes = {top: {"path": top, "kind": "dir"}}
    folders = [top]
    for _ in range(rng.randint(3, 12)):
        at = rng.choice(folders)
        name = rng.choice("abc")
        path = f"{at}/{name}"
        if path in nodes:
            continue
        kind = rng.choices(["file", "dir", "symlink", "fifo"], [5, 4, 2, 1])[0]
        nodes[path] = {"path": path, "kind": kind}
        if kind == "file":
            nodes[path]["content"] = f"{top[1:]} {rng.choice('xyz')}".encode()
        if kind == "symlink":
            nodes[path]["link_target"] = rng.choice(["p", "q"])
        if kind == "dir":
            folders.append(path)
    for n in nodes.values():
        n |= {"mtime_ns": rng.choices([1, 2], [6, 1])[0], "atime_ns": 0, "ctime_ns": 0, "mode": 1, "uid": 1, "gid": 1}
    return nodes


def similar(rng, nodes, top):
    """A changed copy of nodes under another top."""
    old = next(iter(nodes))
    out = {}
    for path, n in nodes.items():
        new = top + path[len(old):]
        if path != old and (new.rpartition("/")[0] not in out or rng.random() < 0.12):
            continue
        out[new] = n | {"path": new}
        if rng.random() < 0.1:
            out[new]["mtime_ns"] = 3
        if n["kind"] == "symlink" and rng.random() < 0.3:
            out[new]["link_target"] = "r"
    return out


def recursive(a, r, rule):
    """Matches {(path, dup_path): (flags, size, items, identical, superset)} and dir records, by recursion."""
    holds = lambda flags: all(f or not getattr(rule, "include_" + name.removesuffix("_match")) for name, f in zip(FLAGS, flags))
    kids = lambda nodes, d: sorted(p for p in nodes if p.rpartition("/")[0] == d)
    names = lambda nodes, d: {p.rpartition("/")[2] for p in kids(nodes, d)}
    stat = lambda p, q: [a[p].get(m) == r[q].get(m) for m in META]
    both = lambda x, y: [i and j for i, j in zip(x, y)]
    matches, totals = {}, {}

    def nonregular(p):
        if a[p]["kind"] != "file":
            yield p
        for c in kids(a, p):
            yield from nonregular(c)

    def item(x, y):
        """(flags, items, not identical, not superset) or None."""
        if y not in r or r[y]["kind"] != a[x]["kind"] or a[x].get("link_target") != r[y].get("link_target"):
            return None
        if a[x]["kind"] == "dir":
            n, m = names(a, x), names(r, y)
            return stat(x, y), 0, n != m, not n <= m
        return stat(x, y), 1, False, False

    def visit(p):
        """(its matches, total size, total items, duplicated size, duplicated items, holds an open special?)."""
        node = a[p]
        if node["kind"] == "file":
            found = {q: (stat(p, q), len(node["content"]), 1) for q, n in r.items() if n["kind"] == "file" and n["content"] == node["content"]}
            for q, (flags, size, n) in found.items():
                matches[p, q] = (flags, size, n, holds(flags), holds(flags))
            size = len(node["content"])
            return set(found), size, 1, size * bool(found), int(bool(found)), False
        if node["kind"] != "dir":
            return set(), 0, 1, 0, 0, True
        results = {c: visit(c) for c in kids(a, p)}
        total = [sum(x[i] for x in results.values()) for i in range(1, 5)]
        candidates = {q.rpartition("/")[0] for c, x in results.items() for q in x[0] if q.rpartition("/")[2] == c.rpartition("/")[2]} - {""}
        waiting = [c for c, x in results.items() if x[5]]
        if not candidates:
            totals[p] = total
            return set(), *total, bool(waiting)
        hits = set()
        for e in candidates:
            flags, size, items = stat(p, e), 0, 0
            matched = {c for c, x in results.items() if f"{e}/{c.rpartition('/')[2]}" in x[0]}
            missed = set(results) - matched - set(waiting)
            mine, theirs = names(a, p), names(r, e)
            bad, worse = mine != theirs or bool(missed), not mine <= theirs or bool(missed)
            for c in matched:
                f, s, i, same, over = matches[c, f"{e}/{c.rpartition('/')[2]}"]
                flags, size, items = both(flags, f), size + s, items + i
                bad, worse = bad or not same, worse or not over
            for t in waiting:
                for x in nonregular(t):
                    got = item(x, e + x[len(p):])
                    if got:
                        flags, items = both(flags, got[0]), items + got[1]
                        bad, worse = bad or got[2], worse or got[3]
                        if got[1]:
                            hits.add(x)
            matches[p, e] = (flags, size, items, holds(flags) and not bad, holds(flags) and not worse)
        total[3] += len(hits)
        totals[p] = total
        return candidates, *total, False

    for top in sorted(p for p in a if "/" not in p):
        visit(top)
    return matches, totals


def test_random_trees(spark):
    rng = random.Random(11)
    a, r = {}, {}
    for i in range(60):
        source = tree(rng, f"r{i}")
        r |= source
        for copy in range(rng.randint(0, 2)):
            r |= {p: n for p, n in similar(rng, {f"r{i}{p[len(f'r{i}'):]}": n for p, n in source.items()}, f"s{i}_{copy}").items()}
        a |= similar(rng, source, f"t{i}")
    rule = MatchRule()
    expected, totals = recursive(a, r, rule)
    left, right = (catalog_of(spark, list(n.values()), root, False) for n, root in ((a, "analyzed"), (r, "repository")))
    left, right = left.persist(), right.persist()
    files = analyze.file_matches(left, right, rule)
    dirs = analyze.dir_matches(left, right, files, rule).persist()
    got = {(m["path"], m["dup_path"]): ([m[f] for f in FLAGS], m["duplicated_size"], m["duplicated_items"], m["is_identical"], m["is_superset"]) for m in files.unionByName(dirs).collect()}
    assert got.keys() == expected.keys()
    wrong = {k: (got[k], v) for k, v in expected.items() if got[k] != v}
    assert not wrong, list(wrong.items())[:3]
    assert sum(k[0].count("/") > 0 and a[k[0]]["kind"] == "dir" for k in got) > 20
    found = {x["path"]: [x["total_size"], x["total_items"], x["duplicated_size"], x["duplicated_items"]] for x in analyze.records(left, right, files, dirs).collect()}
    for path in {k[0] for k in expected if a[k[0]]["kind"] == "dir"}:
        assert found[path] == totals[path], path


def _case(spark, repository, analyzed):
    left, right = catalog_of(spark, analyzed, "analyzed"), catalog_of(spark, repository)
    rows = analyze.analyze(left, right).collect()
    return {x["path"]: x for x in rows}


def test_exact_copy_at_the_root_gives_no_directory(spark):
    got = _case(spark, [{"path": "original.txt", "content": b"x"}], [{"path": "target/duplicate.txt", "content": b"x"}])
    assert got.keys() == {"target/duplicate.txt"}
    match = got["target/duplicate.txt"]["duplicates"][0]
    assert match["is_identical"] and match["duplicated_items"] == 1


def test_superset_and_candidates(spark):
    base = [{"path": f"big/{n}", "content": n.encode()} for n in ("f1", "f2", "extra")]
    got = _case(spark, base, [{"path": f"small/{n}", "content": n.encode()} for n in ("f1", "f2")])["small"]["duplicates"][0]
    assert (got["is_identical"], got["is_superset"], got["duplicated_items"]) == (False, True, 2)
    got = _case(spark, [{"path": "c1/A", "content": b"a"}, {"path": "c2/B", "content": b"b"}], [{"path": "t/A", "content": b"a"}, {"path": "t/B", "content": b"b"}])["t"]
    assert [(m["dup_path"], m["is_identical"], m["is_superset"]) for m in got["duplicates"]] == [("c1", False, False), ("c2", False, False)]


def test_sizes_count_once_in_records(spark):
    repo = [{"path": "dir1/A", "content": b"a" * 100}, {"path": "dir1/B", "content": b"b" * 200}, {"path": "dir2/A", "content": b"a" * 100}, {"path": "dir2/B", "content": b"b" * 200}, {"path": "dir2/C", "content": b"c" * 300}]
    got = _case(spark, repo, [{"path": f"t/{n}", "content": n.lower().encode() * s} for n, s in (("A", 100), ("B", 200), ("C", 300))])["t"]
    assert got["duplicated_size"] == 600 and [(m["dup_path"], m["duplicated_size"]) for m in got["duplicates"]] == [("dir1", 300), ("dir2", 600)]


def test_links_with_other_targets_do_not_block(spark):
    link = {"kind": "symlink", "path": "d/l", "link_target": "x"}
    got = _case(spark, [{"path": "d/f", "content": b"1"}, link], [{"path": "t/f", "content": b"1"}, link | {"path": "t/l", "link_target": "y"}])["t"]
    assert (got["total_items"], got["duplicated_items"]) == (2, 1)
    assert got["duplicates"][0]["is_identical"] and got["duplicates"][0]["duplicated_items"] == 1
