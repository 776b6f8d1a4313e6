import random

import pytest
from pyspark.sql import functions as F

from topicflow.operators import dedup, placement
from topicflow.operators.placement import (
    bounded,
    hot_keys,
    lookup_join,
    shuffled_rank,
    skew_join,
    top_n_per_group,
)


@pytest.fixture
def skewed(spark):
    # one key holds most rows, some keys are null
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i % 50}")) for i in range(600)]
    return spark.createDataFrame(rows, "id long, key string")


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("k6", 4)], "key string, value int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(skewed, lookup, how):
    hot = hot_keys(skewed, "key", share=4, min_rows=1)
    assert [r.key for r in hot.collect()] == ["hot"]
    ours = skew_join(skewed, lookup, "key", ["id"], how, hot=hot, salts=8)
    plain = skewed.join(lookup, "key", how)
    assert sorted(map(str, ours.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_hot_rows_are_spread(skewed, lookup):
    hot = hot_keys(skewed, "key", share=4, min_rows=1)
    salts = F.pmod(F.xxhash64("id"), F.lit(8))
    assert skewed.join(hot, "key").select(salts).distinct().count() == 8


def test_lookup_join_is_the_same_when_the_lookup_is_large(skewed, lookup):
    small = lookup_join(skewed, lookup, "key", ["id"], "left")
    large = lookup_join(skewed, lookup, "key", ["id"], "left", max_rows=1)
    assert bounded(lookup, 1) is None
    assert sorted(map(str, small.select("id", "value").collect())) == sorted(map(str, large.select("id", "value").collect()))


def test_rank_and_top_n(spark):
    rows = [(i, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g int").repartition(7)
    import hashlib

    order = lambda i: (hashlib.md5(f"{i}45".encode()).hexdigest(), i)
    expected = {}
    for g in range(3):
        for rank, i in enumerate(sorted((i for i, x in rows if x == g), key=order)):
            expected[i] = rank
    ranked = shuffled_rank(df, ["g"], "id", digits=1)
    assert {r.id: r["rank"] for r in ranked.collect()} == expected
    hashed = df.withColumn("h", placement.shuffle_hash(F.col("id"), 45))
    top = top_n_per_group(hashed, ["g"], [F.col("h"), F.col("id")], 5, ["id"])
    assert {(r.id, r.rn - 1) for r in top.collect()} == {(i, r) for i, r in expected.items() if r < 5}


def brute_duplicates(rows):
    texts = ["None" if c is None else c for _, c in rows]
    kept = {u for (u, _), t in zip(rows, texts) if texts.count(t) == 1}
    return kept, {u for u, _ in rows} - kept


@pytest.mark.parametrize("hot_rows", [1, 10_000])
def test_all_copies_are_dropped(spark, monkeypatch, hot_rows):
    """The same whether repeated texts count as hot or not."""
    defaults = list(hot_keys.__defaults__)
    monkeypatch.setattr(hot_keys, "__defaults__", (3, hot_rows, None))
    random.seed(1)
    texts = ["copy"] * 40 + ["None", None] + [f"t{random.randrange(60)}" for _ in range(60)]
    rows = [(f"u{i}", t) for i, t in enumerate(texts)]
    for partitions in (1, 5):
        df = spark.createDataFrame(rows, "url string, content string").repartition(partitions)
        kept, rejected = dedup.drop_all_duplicates(df)
        expected = brute_duplicates(rows)
        assert ({r.url for r in kept.collect()}, {r.url for r in rejected.collect()}) == expected
        assert rejected.count() == len(expected[1])
    assert defaults == [1000, 10_000, None]


def test_empty_batches(spark):
    df = spark.createDataFrame([], "url string, content string")
    kept, rejected = dedup.drop_all_duplicates(df)
    assert kept.isEmpty() and rejected.isEmpty()
    batches = spark.createDataFrame([([],), ([("u", "t")],)], "batch array<struct<url:string,content:string>>")
    assert dedup.flatten_batches(batches).collect() == [("u", "t")]


def test_fresh_since_raises_on_a_malformed_time(spark):
    df = spark.createDataFrame([("u", "12.12.1999")], "url string, parse_datetime string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        dedup.fresh_since(df, "2024-01-01").collect()
