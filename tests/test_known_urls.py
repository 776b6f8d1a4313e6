import pytest
from pyspark.sql import functions as F

from topicflow.sources.known_urls import KnownUrls


def urls(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url string")


def listed(df):
    return sorted(r.url or "" for r in df.collect())


def test_added_urls_are_known(spark, tmp_path):
    index = KnownUrls(spark, str(tmp_path / "known"), 8)
    assert listed(index.unknown(urls(spark, "a", "a", None))) == ["", "a", "a"]
    index.add(urls(spark, "a", "b", "a", None))
    index.add(urls(spark, "b", "c"))
    assert listed(index.read()) == ["a", "b", "c"]
    assert listed(index.unknown(urls(spark, "a", "d", "d", "c", None))) == ["", "d", "d"]
    index.add(urls(spark))
    assert index.read().count() == 3


def test_other_columns_stay(spark, tmp_path):
    index = KnownUrls(spark, str(tmp_path / "known"), 4)
    index.add(urls(spark, "a"))
    rows = urls(spark, "a", "b").withColumn("html", F.lit("x"))
    assert [tuple(r) for r in index.unknown(rows).collect()] == [("b", "x")]


def test_a_session_that_lost_its_catalog_finds_the_urls(spark, tmp_path):
    index = KnownUrls(spark, str(tmp_path / "it's known"), 4)
    index.add(urls(spark, *map(str, range(50))))
    spark.sql(f"DROP TABLE {index.table}")
    again = KnownUrls(spark, str(tmp_path / "it's known"), 4)
    assert again.read().count() == 50
    assert listed(again.unknown(urls(spark, "7", "77"))) == ["77"]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_list_is_not_moved(spark, tmp_path, no_broadcast):
    index = KnownUrls(spark, str(tmp_path / "known"), 8)
    index.add(urls(spark, *map(str, range(100))))
    anti = urls(spark, "1", "x").select("url").distinct().join(index.read(), "url", "left_anti")
    plan = anti._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FileScan parquet") - 400 :]
    assert "Bucketed: true" in below
    # one exchange, that of the candidates; it gives both the distinct urls and the join its places
    assert plan.count("Exchange") == 1
