"""Topic names, topic edges and the parts of the published artifact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_sentences, format_time
from ..functions.vectors import as_array, mean_vector
from .distances import top_words
from .groups import explode_paths, join_strings, topic_path
from .placement import shuffle_hash
from .sampling import sample_per_topic

# Search words of the published page; a site passes its own name here.
FIXED_KEYWORDS = ("news",)
CHUNK_ROWS = 1000


def topic_names(
    vectors: DataFrame, labels: DataFrame, levels: Sequence[str], word_vectors: DataFrame, key: str = "url", k: int = 5
) -> DataFrame:
    """(level, topic_path, name): the words closest to the mean vector of each path.

    Vectors are averaged once, by the labels of all levels; a path's mean is the weighted mean
    of the averages below it.
    """
    deepest = vectors.select(key, "features").join(labels.select(key, *levels), key).groupBy(*levels)
    means = deepest.agg(mean_vector("features").alias("m"), F.count("*").alias("n"))
    paths = explode_paths(means, levels, "m", "n")
    weighed = paths.groupBy(F.col("topic_path").alias("label")).agg(mean_vector(F.col("m"), F.col("n").cast("double")).alias("m"))
    words = top_words(weighed.select("label", as_array(F.col("m")).alias("centroid")), word_vectors, k)
    names = join_strings(words, ["label"], "rn", "word", " ")
    return names.select(
        (F.size(F.split("label", "_")) - 1).alias("level"),
        F.col("label").alias("topic_path"),
        F.col("joined").alias("name"),
    )


def deepest_paths(labels: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct deepest paths."""
    path = F.coalesce(*(topic_path(levels, i) for i in range(len(levels) - 1, -1, -1)))
    return labels.select(path.alias("topic_path")).where("topic_path IS NOT NULL").distinct()


def topic_edges(labels: DataFrame, names: DataFrame, levels: Sequence[str]) -> DataFrame:
    """(parent, child) names along every path; a path of one level points to itself.

    ``names`` is (topic_path, name).  Works on the distinct paths, not on the articles.
    """
    parts = F.split("topic_path", "_")
    # child prefix lengths 2..n; a single level gives the edge 1 → 1
    steps = F.when(F.size(parts) == 1, F.array(F.lit(1))).otherwise(F.sequence(F.lit(2), F.size(parts)))
    ends = deepest_paths(labels, levels).select("topic_path", F.explode(steps).alias("n"))
    prefix = lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_")
    edges = ends.select(
        prefix(F.greatest(F.col("n") - 1, F.lit(1))).alias("parent_path"), prefix(F.col("n")).alias("child_path")
    ).distinct()
    parents = names.select(F.col("topic_path").alias("parent_path"), F.col("name").alias("parent"))
    children = names.select(F.col("topic_path").alias("child_path"), F.col("name").alias("child"))
    return edges.join(parents, "parent_path").join(children, "child_path").select("parent", "child").distinct()


def topic_keywords(names: DataFrame, fixed: Sequence[str] = FIXED_KEYWORDS) -> DataFrame:
    """One row (keywords): the fixed words and every word of the top topics' names, repeats kept."""
    tops = names.where("level = 0").select("topic_path", "name")
    words = F.array_sort(F.collect_list(F.struct("topic_path", "name")))
    spoken = F.flatten(F.transform(words, lambda n: F.split(n["name"], " ")))
    listed = F.concat(F.array(*map(F.lit, fixed)), spoken)
    return tops.agg(F.array_join(listed, ", ").alias("keywords"))


def global_overview(topic_summaries: DataFrame, n: int = 3) -> DataFrame:
    """One row (overview): the first sentences of each top topic's summary, one line each."""
    tops = topic_summaries.where("NOT contains(topic_path, '_')")
    lines = F.array_sort(F.collect_list(F.struct("topic_path", first_sentences(F.col("summary"), n).alias("s"))))
    return tops.agg(F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("overview"))


def _one_per_key(df: DataFrame, key: str) -> DataFrame:
    """The smallest row of each key, on the partitioning that a join on the key needs anyway."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def assemble_articles(articles: DataFrame, summaries: DataFrame, labels: DataFrame, key: str = "url") -> DataFrame:
    """(url, summary, l0, l1, ...): one row per key that all three tables have.

    With the key of ``with_row_key``, repeated urls are rows of their own.  With the url as the
    key, a url is one row whatever its repeats, with its smallest summary and labels.
    """
    own = articles.select(key, "url").distinct() if key != "url" else articles.select("url").distinct()
    joined = own.join(_one_per_key(summaries, key), key).join(_one_per_key(labels, key), key)
    return joined if key == "url" else joined.drop(key)


def article_columns(
    assembled: DataFrame, levels: Sequence[str], key: str = "url", seed: int = 45, rows: int = CHUNK_ROWS
) -> DataFrame:
    """(chunk, columns...): articles in seeded order, transposed to one array per column.

    The artifact's article block is cut in chunks of about ``rows`` articles by the leading
    hash bits.  Chunks in order give exactly the shuffled article list, and none of them
    grows with the corpus.
    """
    n = assembled.agg(F.count("*")).scalar()
    chunks = F.greatest(F.ceil(n / rows), F.lit(1))
    place = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    columns = [key, "summary", *levels]
    hashed = assembled.withColumn("_hash", shuffle_hash(F.col(key), seed))
    chunked = hashed.withColumn("chunk", F.shiftright(place * chunks, 32).cast("int"))
    ordered = chunked.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("_hash", *columns))).alias("a"))
    return ordered.select("chunk", *(F.col(f"a.{c}").alias(c) for c in columns))


def short_links(assembled: DataFrame, n: int = 100, key: str = "url") -> DataFrame:
    """(l0, rn, url, summary): at most ``n`` articles of each top topic."""
    return sample_per_topic(assembled.where("l0 IS NOT NULL"), n, "l0", key).select("l0", "rn", key, "summary")


def artifact_header(
    assembled: DataFrame,
    topic_summaries: DataFrame,
    names: DataFrame,
    sources: DataFrame,
    update_time: Column,
    links_per_topic: int = 100,
    key: str = "url",
    keywords: Sequence[str] = FIXED_KEYWORDS,
) -> DataFrame:
    """One row with all parts whose size depends on topics, not on articles."""
    links = short_links(assembled, links_per_topic, key)
    linked = F.array_sort(F.collect_list(F.struct("l0", "rn", key, "summary")))
    summaries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic_path", "summary"))))
    return assembled.agg(F.count("*").alias("news_count")).select(
        "news_count",
        sources.agg(F.count("*")).scalar().alias("sources_count"),
        format_time(update_time).alias("update_time"),
        topic_keywords(names, keywords).scalar().alias("keywords"),
        global_overview(topic_summaries).scalar().alias("short_global_overview"),
        topic_summaries.agg(summaries).scalar().alias("topic_summaries"),
        links.agg(F.transform(linked, lambda x: F.array(x[key], x["summary"]))).scalar().alias("short_global_links"),
    )


def to_artifact_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_artifact(header: DataFrame, columns: DataFrame, path: str) -> None:
    """``header``: one JSON object; ``articles``: the chunks of the article block."""
    to_artifact_json(header).write.mode("overwrite").text(f"{path}/header")
    to_artifact_json(columns).write.mode("overwrite").text(f"{path}/articles")
