import os

import pytest
from pyspark.sql import functions as F

from twinset.operators import index
from twinset.operators.repository import IndexNotFound, Repository, find_report, find_repository, read_report, report_is_valid
from twinset.sources.filesystem import catalog_from_fs, resolve_symlink


def _write(root, files):
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
        os.utime(at, ns=(10**18, 10**18))
    for folder, _, _ in os.walk(root):
        os.utime(folder, ns=(10**18, 10**18))


def test_rebuild_refresh_analyze(spark, tmp_path):
    root, target = tmp_path / "repo", tmp_path / "target"
    root.mkdir(), target.mkdir()
    with pytest.raises(IndexNotFound):
        Repository(spark, str(root))
    _write(root, {"d/a.txt": b"a", "d/b.txt": b"b", "empty": b"", ".hid/x": b""})
    repo = Repository(spark, str(root), create=True)
    with pytest.raises(RuntimeError):
        repo.refresh()
    repo.rebuild()
    first = {x["path"]: x["digest"] for x in repo.signatures().collect()}
    assert first.keys() == {"d/a.txt", "d/b.txt", "empty", ".hid/x"} and first["empty"] == first[".hid/x"]
    ident = repo.manifest["repository-id"]
    _write(target, {"d/a.txt": b"a", "d/b.txt": b"b"})
    os.utime(root / "d", ns=(10**18, 10**18))
    assert repo.analyze([str(target)])
    rows, manifest = read_report(spark, str(target))
    match = rows.where("path = 'target/d'").first()["duplicates"][0]
    assert match["dup_path"] == "d" and match["is_identical"] and manifest["repository_id"] == ident
    assert report_is_valid(str(target), repo)
    assert find_report(str(target / "d" / "a.txt")) == (str(target), "target/d/a.txt")
    assert find_repository(str(root / "d")) == (str(root), "d")
    (root / "d/b.txt").unlink()
    (root / "new").write_bytes(b"n")
    (root / "d/a.txt").write_bytes(b"changed")
    repo.refresh()
    second = {x["path"]: x["digest"] for x in repo.signatures().collect()}
    assert second.keys() == {"d/a.txt", "new", "empty", ".hid/x"} and second["d/a.txt"] != first["d/a.txt"] and repo.manifest["repository-id"] == ident
    assert any(line.startswith("manifest-property hash-algorithm sha256") for line in repo.inspect())


def test_import_nested_and_ancestor(spark, tmp_path):
    outer, inner = tmp_path / "o", tmp_path / "o/s/n"
    inner.mkdir(parents=True)
    _write(inner, {"f": b"1"})
    _write(outer, {"g": b"2"})
    a, b = Repository(spark, str(outer), True), Repository(spark, str(inner), True)
    a.rebuild(), b.rebuild()
    b_only = b.signatures().count()
    a.import_index(str(inner))
    assert "s/n/f" in {x["path"] for x in a.signatures().collect()}
    b.import_index(str(outer))
    assert {x["path"] for x in b.signatures().collect()} >= {"f"} and b.signatures().count() >= b_only
    with pytest.raises(ValueError):
        a.import_index(str(outer))


def test_classes_of_colliding_digests(spark):
    schema = "path string, digest string, mtime_ns long, content string"
    target = index.assign_ec(spark.createDataFrame([("a", "0", 1, "one"), ("b", "0", 1, "one")], schema), None, "content")
    source = index.assign_ec(spark.createDataFrame([("x", "0", 1, "two"), ("y", "0", 1, "one")], schema), None, "content")
    got = {x["path"]: x["ec_id"] for x in index.import_signatures(target, source, "sub", content="content").collect()}
    assert got == {"a": 0, "b": 0, "sub/x": 1, "sub/y": 0}


def test_refresh_keeps_files_whose_time_went_back(spark):
    old = spark.createDataFrame([("a", "0", 5, 0), ("b", "0", 5, 0), ("c", "0", 5, None), ("d", "0", 5, 0)], "path string, digest string, mtime_ns long, ec_id int")
    new = spark.createDataFrame([("a", "file", 4, "1"), ("b", "file", 6, "1"), ("c", "file", 5, "1"), ("e", "file", 1, "1")], "path string, kind string, mtime_ns long, digest string")
    plan = lambda force: {x["path"]: x["action"] for x in index.refresh_plan(old, new, force).collect()}
    assert plan(False) == {"a": "keep", "b": "update", "c": "update", "d": "delete", "e": "insert"}
    assert plan(True)["a"] == "update"


def test_links(spark, tmp_path):
    outside, top = tmp_path / "outside", tmp_path / "top"
    outside.mkdir(), top.mkdir()
    (outside / "f").write_bytes(b"1")
    for name in ("followed", "plain"):
        (top / name).symlink_to("../outside")
    (top / "loop").symlink_to("loop")
    (top / "within").symlink_to("followed")
    rows = {x["path"]: x["kind"] for x in catalog_from_fs(spark, str(top), follow=("followed", "loop", "within"), digests=False).collect()}
    assert rows == {"followed": "dir", "followed/f": "file", "plain": "symlink", "loop": "symlink", "within": "symlink"}
    assert resolve_symlink(str(top / "plain"), []) == str(outside)
    single = catalog_from_fs(spark, str(outside / "f"), "analyzed", yield_root=True).where(F.col("digest").isNotNull()).collect()
    assert [x["path"] for x in single] == ["f"]
