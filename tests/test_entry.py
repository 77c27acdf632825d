import duckdb
import pytest

import __spark_entry__ as entry
from twinset.plans import doccat

DATA = "/root/testdata/sf0.001"
CHOSEN = ["catalog", "ec_ids_weak_hash", "file_matches", "dir_match_flags", "dir_records", "describe_children_dup_size", "difftree_depth3", "refresh_apply", "import_nested", "inspect_lines", "describe_rows", "special_items", "special_totals", "pages_article_dup", "conversations_shape_dup"]


def test_every_reference_query_has_sql():
    assert doccat.queries().keys() == doccat.oracle_sql().keys()


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = doccat.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    cursor = con.execute(doccat.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(str([row[names.index(c)] for c in columns]) for row in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == expected


@pytest.mark.parametrize("name", ["special_items", "pages_article_dup", "conversations_shape_dup"])
def test_there_are_rows(spark, name):
    assert doccat.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
