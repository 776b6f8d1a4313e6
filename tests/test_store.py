import pytest

from topicflow.operators.dedup import fresh_since
from topicflow.sources import store

ROWS1 = [("u1", "t1", "c1", None, "12.12.1999"), ("u2", "t2", "c2", None, "12.12.1999")]
ROWS2 = [("u3", "t3", "c3", None, "13.12.1999"), ("u4", "t4", None, None, "13.12.1999")]


def paths(spark, tmp_path):
    found = str(tmp_path / "articles"), str(tmp_path / "rejected")
    store.ensure_tables(spark, *found)
    return found


def test_reset_gives_empty_tables_with_columns(spark, tmp_path):
    articles, rejected = paths(spark, tmp_path)
    store.append_articles(spark.createDataFrame(ROWS1, store.ARTICLES), articles)
    store.append_rejected(spark.createDataFrame([("x",)], store.REJECTED), rejected)
    store.reset_table(spark, articles, store.ARTICLES)
    store.reset_table(spark, rejected, store.REJECTED)
    assert store.read_articles(spark, articles).columns == ["url", "title", "content", "published_at", "parse_datetime"]
    assert store.read_articles(spark, articles).isEmpty()
    assert store.urls_to_ignore(store.read_articles(spark, articles), store.read_rejected(spark, rejected)).isEmpty()


def test_rejected_urls_round_trip(spark, tmp_path):
    articles, rejected = paths(spark, tmp_path)
    for batch in ([("a",), ("b",)], [("c",), ("a",)]):
        store.append_rejected(spark.createDataFrame(batch, store.REJECTED), rejected)
    ignore = store.urls_to_ignore(store.read_articles(spark, articles), store.read_rejected(spark, rejected))
    assert sorted(r.url for r in ignore.collect()) == ["a", "a", "b", "c"]


def test_append_twice_and_ignore_list(spark, tmp_path):
    articles, rejected = paths(spark, tmp_path)
    for rows in (ROWS1, ROWS2):
        store.append_articles(spark.createDataFrame(rows, store.ARTICLES), articles)
    store.append_rejected(spark.createDataFrame([("x",)], store.REJECTED), rejected)
    stored = store.read_articles(spark, articles)
    assert sorted(map(tuple, stored.collect())) == ROWS1 + ROWS2
    ignore = store.urls_to_ignore(stored, store.read_rejected(spark, rejected))
    assert sorted(r.url for r in ignore.collect()) == ["u1", "u2", "u3", "u4", "x"]


def test_ensure_keeps_rows(spark, tmp_path):
    articles, rejected = paths(spark, tmp_path)
    store.append_articles(spark.createDataFrame(ROWS1, store.ARTICLES), articles)
    store.ensure_tables(spark, articles, rejected)
    assert store.read_articles(spark, articles).count() == 2


def test_fresh_reads_take_the_days_they_need(spark, tmp_path, capsys):
    articles, _ = paths(spark, tmp_path)
    assert store.read_articles(spark, articles, "2024-03-05").isEmpty()
    rows = [(f"u{d}", "t", "c", None, f"2024-03-{d:02} 10:00:00") for d in range(1, 11)]
    store.append_articles(spark.createDataFrame(rows, store.ARTICLES), articles)
    found = store.read_articles(spark, articles, "2024-03-08 12:00:00")
    assert sorted(r.url for r in found.collect()) == ["u10", "u7", "u8", "u9"]
    assert sorted(r.url for r in fresh_since(found, "2024-03-08 12:00:00").collect()) == ["u10", "u9"]
    fresh_since(found, "2024-03-08 12:00:00").explain("formatted")
    assert "PartitionFilters: [((parse_date" in capsys.readouterr().out


def test_times_that_are_none_still_raise(spark, tmp_path):
    articles, _ = paths(spark, tmp_path)
    store.append_articles(spark.createDataFrame(ROWS1, store.ARTICLES), articles)
    found = store.read_articles(spark, articles, "2024-03-08 12:00:00")
    assert found.count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fresh_since(found, "2024-03-08 12:00:00").collect()
