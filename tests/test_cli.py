import os

import pytest

from twinset import cli
from twinset.functions.digest import file_digests
from twinset.operators.repository import Repository, find_report, read_report

TIME = (10**18, 10**18)


def _write(root, files):
    for path, content in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    for folder, _, names in os.walk(root):
        for n in [*names, "."]:
            os.utime(os.path.join(folder, n), ns=TIME, follow_symlinks=False)


@pytest.fixture
def place(spark, tmp_path, monkeypatch):
    root, target = tmp_path / "repo", tmp_path / "target"
    root.mkdir(), target.mkdir()
    _write(root, {"d/a.txt": b"a" * 2048, "d/b.txt": b"b", "e/a.txt": b"a" * 2048, "d/c": b"c"})
    _write(target, {"d/a.txt": b"a" * 2048, "d/b.txt": b"b", "new": b"new"})
    monkeypatch.delenv(cli.VARIABLE, raising=False)
    return root, target


def test_commands(spark, place, tmp_path, monkeypatch, capsys):
    root, target = place
    with pytest.raises(Exception):
        cli.main(["--repository", str(root), "inspect"])  # no index yet
    monkeypatch.setenv(cli.VARIABLE, str(root))
    log = tmp_path / "log"
    assert cli.main(["--verbose", "--log-file", str(log), "rebuild"]) == 0
    assert "rebuilding with sha256" in capsys.readouterr().err and "rebuilt" in log.read_text()
    assert cli.main(["refresh"]) == 0
    cli.main(["inspect"])
    lines = capsys.readouterr().out.splitlines()
    assert sum(x.startswith("file-metadata ") for x in lines) == 4 and any(x.startswith("manifest-property hash-algorithm sha256") for x in lines)
    cli.main(["analyze", str(target)])
    assert find_report(str(target))[1] == "target"
    capsys.readouterr()
    cli.main(["describe", str(target)])
    out = capsys.readouterr().out
    table = out.split("\n\n")[1].splitlines()
    assert [x.split() for x in table[2:]] == [["d", "Dir", "2.00", "KB", "2.00", "KB", "100.0%", "2", "2", "100.0%", "2", "2.00", "KB", "100.0%", "Superset", "Yes"], ["new", "File", "-", "0", "B", "-", "-", "-", "-", "0", "0", "B", "-", "-", "No"]]
    cli.main(["describe", "--details", "--all", "--bytes", str(target / "d" / "a.txt")])
    out = capsys.readouterr().out
    assert "Repository: " + str(root) in out and "Terms" in out and "e/a.txt" in out and "2048 bytes" in out
    for flags, first in (([], "d"), (["--keep-input-order"], "new")):
        cli.main(["describe", *flags, str(target / "new"), str(target / "d")])
        assert capsys.readouterr().out.splitlines()[2].split()[0] == first
    with pytest.raises(SystemExit):
        cli.main(["describe", "--keep-input-order", str(target)])
    with pytest.raises(SystemExit):
        cli.main(["describe", str(tmp_path)])
    cli.main(["diff-tree", str(target / "d"), str(root / "d"), "--unlimited"])
    assert "c [R]" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["diff-tree", str(target / "d"), str(root)])


def test_contents_are_compared(spark, tmp_path):
    """A hash of the length alone: only bytes tell contents apart."""
    root, target = tmp_path / "repo", tmp_path / "target"
    root.mkdir(), target.mkdir()
    _write(root, {"a": b"one", "b": b"two", "c": b"one", "d": b"six", "e": b"longer"})
    _write(target, {"x": b"two", "y": b"ten", "z": b"longer"})
    weak = {"weak": (1, None, lambda f: f"{len(f.read()):02d}")}
    heard = []
    repo = Repository(spark, str(root), True, algorithms=weak, listen=heard.append)
    repo.rebuild("weak")
    classes = repo.lookup("03")
    assert sorted(classes.values()) == [["a", "c"], ["b"], ["d"]] and repo.lookup("06") == {0: ["e"]} and heard
    repo.analyze([str(target)])
    rows = {r["path"]: [m["dup_path"] for m in r["duplicates"]] for r in read_report(spark, str(target))[0].collect()}
    assert rows["target/x"] == ["b"] and rows["target/z"] == ["e"] and "target/y" not in rows
    (root / "f").write_bytes(b"six"), (root / "g").write_bytes(b"ten")
    repo.refresh()
    again = {p: k for k, paths in repo.lookup("03").items() for p in paths}
    assert again["f"] == again["d"] and again["g"] == 3 and {p: again[p] for p in "abcd"} == {p: k for k, paths in classes.items() for p in paths}
    with pytest.raises(RuntimeError):
        Repository(spark, str(root)).refresh()  # the algorithm is not known there
    repo.truncate()
    assert repo.signatures().count() == 0 and repo.manifest["hash-algorithm"] == "weak"
    assert file_digests(spark.createDataFrame([("gone",)], "path string"), str(root)).first()["digest"] is None


def test_import_compares_contents_and_links(spark, tmp_path):
    outer, inner = tmp_path / "o", tmp_path / "o/s/n"
    inner.mkdir(parents=True)
    _write(inner, {"f": b"1", "g": b"2"})
    _write(outer, {"h": b"2"})
    weak = {"weak": (1, None, lambda f: f"{len(f.read()):02d}")}
    a, b = (Repository(spark, str(p), True, algorithms=weak) for p in (outer, inner))
    b.rebuild("weak")
    a.rebuild("weak")
    a._swap(a.signatures().where("path = 'h'"))
    a.import_index(str(inner))
    found = {p: k for k, paths in a.lookup("01").items() for p in paths}
    assert found["h"] == found["s/n/g"] != found["s/n/f"]
    os.rename(outer / "s", outer / "real")
    os.symlink("real", outer / "s")
    with pytest.raises(ValueError):
        a.import_index(str(outer / "s" / "n"))
    assert Repository(spark, str(outer), follow=lambda path, target: path == "s").followed() == ("s",)
