"""Every registered query against its SQL, at the smallest scale."""

import pytest
from oracle import difference, duck

import __spark_entry__ as entry

SF = "sf0.001"
SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(spark, SF, name, entry.queries()[name], SQL[name], duck(SF)) is None


@pytest.mark.parametrize("name", ["cluster", "merge_by_distance", "soft_clusters", "extractive_summary", "choose_k"])
def test_query_without_sql_has_rows(spark, name):
    assert difference(spark, SF, name, entry.queries()[name], None) is None


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["level", "topic_path", "articles", "summary"]
