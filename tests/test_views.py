from twinset.functions.metadata import human_size, percentage
from twinset.operators import describe, difftree


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "rel string, kind string, status string")


def test_golden_tree(spark):
    d, a, r = "DIFFERENT", "ANALYZED_ONLY", "REPOSITORY_ONLY"
    rows = [("", "dir", d), ("level1", "dir", d), ("level1/identical_l1.txt", "file", "IDENTICAL"), ("level1/level2a", "dir", d), ("level1/level2a/level3a", "dir", d)]
    rows += [(f"level1/level2a/level3a/{n}_{i}.txt", "file", s) for n, s in (("analyzed_only", a), ("repository_only", r)) for i in (1, 2)]
    rows += [("level1/level2b", "dir", d), ("level1/level2b/level3b", "dir", d), ("level1/level2b/level3b/different.txt", "file", d), ("level1/same", "dir", "IDENTICAL"), ("level1/same/x", "file", d)]
    shown = [x.asDict() for x in difftree.diff_tree(_nodes(spark, rows), max_depth=None).collect()]
    assert difftree.render(shown, "target").split("\n")[1:] == [
        "└── level1 [D]",
        "    ├── level2a [D]",
        "    │   └── level3a [D]",
        "    │       ├── analyzed_only_1.txt [A]",
        "    │       ├── analyzed_only_2.txt [A]",
        "    │       ├── repository_only_1.txt [R]",
        "    │       └── repository_only_2.txt [R]",
        "    └── level2b [D]",
        "        └── level3b [D]",
        "            └── different.txt [D]",
    ]
    assert difftree.render([], "target") == "Directories are identical."


def test_depth_and_filters(spark):
    rows = [("l1", "dir", "DIFFERENT"), ("l1/l2", "dir", "DIFFERENT"), ("l1/l2/l3", "dir", "DIFFERENT"), ("l1/l2/l3/l4", "dir", "DIFFERENT"), ("l1/l2/l3/l4/deep", "file", "DIFFERENT")]
    shown = [x.asDict() for x in difftree.diff_tree(_nodes(spark, rows), max_depth=3).collect()]
    assert difftree.render(shown, "t").split("\n")[1:] == ["└── l1 [D]", "    └── l2 [D]", "        └── l3 [D]", "            └── ..."]
    rows = [("p", "dir", "DIFFERENT"), ("p/c", "dir", "DIFFERENT"), ("p/c/only", "file", "REPOSITORY_ONLY")]
    assert difftree.diff_tree(_nodes(spark, rows), max_depth=None, show="analyzed").count() == 0
    assert difftree.diff_tree(_nodes(spark, rows), max_depth=None, show="repository").count() == 3


def test_orders(spark):
    rows = [("p", "a/long/path", 10, 1, True, True), ("p", "b", 10, 5, False, True), ("p", "c/d", 30, 2, False, False), ("p", "e", 30, 2, False, False)]
    m = spark.createDataFrame(rows, "path string, dup_path string, duplicated_size long, duplicated_items long, is_identical boolean, is_superset boolean")
    order = lambda by: [x["dup_path"] for x in describe.describe_duplicates(m, by, None).orderBy("place").collect()]
    assert order("size") == ["e", "c/d", "a/long/path", "b"]
    assert order("items") == ["b", "e", "c/d", "a/long/path"]
    assert order("identical") == ["a/long/path", "b", "e", "c/d"]
    assert order("path") == ["b", "e", "c/d", "a/long/path"]


def test_texts():
    assert [human_size(n) for n in (0, 1023, 1024, 1536, 5 * 1024**4)] == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "5.00 TB"]
    assert [percentage(*x) for x in ((1, 0), (1, 2), (9999, 10000), (1, 10000), (3, 3))] == ["0.0%", "50.0%", "~100.0%", "~0.0%", "100.0%"]
