"""Parts of the report and the artifact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as R
from ..operators.summaries import lead_summarizer, summarize_topics
from ..session import new_path
from .base import (
    LEVELS,
    SUMMARIES,
    TOPIC_LABELS,
    article_summaries,
    articles,
    first_sentences_sql,
    query,
    topic_labels,
)
from .topics import TOPIC_SUMMARIES

NAMES = """names AS (
    SELECT 0 AS level, topic_path, 'news of ' || topic_path AS name FROM (SELECT DISTINCT l0 :: VARCHAR AS topic_path FROM topic_labels)
    UNION ALL SELECT 1, topic_path, 'news of ' || topic_path FROM (SELECT DISTINCT l0 || '_' || l1 AS topic_path FROM topic_labels))"""


def names(spark, sf):
    paths = R.explode_paths(topic_labels(spark, sf), LEVELS).distinct()
    return paths.select("level", "topic_path", F.concat(F.lit("news of "), F.col("topic_path")).alias("name"))


def assembled(spark, sf):
    return R.assemble_articles(articles(spark, sf), article_summaries(spark, sf), topic_labels(spark, sf))


@query("assemble_articles", f"WITH {SUMMARIES}, {TOPIC_LABELS} SELECT url, summary, l0, l1 FROM summaries JOIN topic_labels USING (url)")
def assembled_articles(spark, sf):
    return assembled(spark, sf)


@query(
    "topic_edges",
    f"""WITH {TOPIC_LABELS} SELECT DISTINCT 'news of ' || l0 AS parent, 'news of ' || l0 || '_' || l1 AS child FROM topic_labels""",
)
def topic_edges(spark, sf):
    return R.topic_edges(topic_labels(spark, sf), names(spark, sf).select("topic_path", "name"), LEVELS)


@query(
    "topic_keywords",
    f"""WITH {TOPIC_LABELS}, {NAMES} SELECT 'daily, news, ' ||
        string_agg(replace(name, ' ', ', '), ', ' ORDER BY topic_path) AS keywords FROM names WHERE level = 0""",
)
def topic_keywords(spark, sf):
    return R.topic_keywords(names(spark, sf), ("daily", "news"))


@query(
    "global_overview",
    f"""WITH {TOPIC_SUMMARIES} SELECT string_agg({first_sentences_sql('summary')}, chr(10) ORDER BY topic_path) AS overview
    FROM topic_summaries WHERE level = 0""",
)
def global_overview(spark, sf):
    rows = article_summaries(spark, sf).join(topic_labels(spark, sf), "url")
    return R.global_overview(summarize_topics(rows, LEVELS, lead_summarizer()))


@query(
    "short_links",
    f"""WITH {SUMMARIES}, {TOPIC_LABELS} SELECT l0, CAST(rn AS INTEGER) AS rn, url, summary FROM (
        SELECT *, row_number() OVER (PARTITION BY l0 ORDER BY md5(url || l0), url) AS rn
        FROM summaries JOIN topic_labels USING (url)) WHERE rn <= 100""",
)
def short_links(spark, sf):
    return R.short_links(assembled(spark, sf))


@query(
    "article_columns",
    f"""WITH {SUMMARIES}, {TOPIC_LABELS}, hashed AS (
        SELECT url, summary, l0, l1, md5(url || '45') AS h FROM summaries JOIN topic_labels USING (url)),
    sized AS (SELECT greatest(CAST(ceil(count(*) / 100) AS BIGINT), 1) AS chunks FROM hashed)
    SELECT CAST((CAST('0x' || substr(h, 1, 8) AS BIGINT) * chunks) >> 32 AS INTEGER) AS chunk,
        string_agg(url, '|' ORDER BY h) AS urls, string_agg(summary, '|' ORDER BY h) AS summaries,
        string_agg(l0 :: VARCHAR, '|' ORDER BY h) AS l0, string_agg(l1 :: VARCHAR, '|' ORDER BY h) AS l1
    FROM hashed, sized GROUP BY chunk""",
)
def article_columns(spark, sf):
    chunks = R.article_columns(assembled(spark, sf), LEVELS, rows=100)
    return chunks.select(
        "chunk",
        F.array_join("url", "|").alias("urls"),
        F.array_join("summary", "|").alias("summaries"),
        *(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) for c in LEVELS),
    )


CHUNKS_JSON = f"""hashed AS (
    SELECT url, summary, l0, l1, md5(url || '45') AS h FROM summaries JOIN topic_labels USING (url)),
sized AS (SELECT greatest(CAST(ceil(count(*) / 100) AS BIGINT), 1) AS chunks FROM hashed),
placed AS (SELECT *, CAST((CAST('0x' || substr(h, 1, 8) AS BIGINT) * chunks) >> 32 AS INTEGER) AS chunk FROM hashed, sized),
chunk_json AS (SELECT CAST(to_json({{'chunk': chunk, 'url': list(url ORDER BY h), 'summary': list(summary ORDER BY h),
    'l0': list(l0 ORDER BY h), 'l1': list(l1 ORDER BY h)}}) AS VARCHAR) AS value FROM placed GROUP BY chunk)"""


@query("to_artifact_json", f"WITH {SUMMARIES}, {TOPIC_LABELS}, {CHUNKS_JSON} SELECT value FROM chunk_json")
def to_artifact_json(spark, sf):
    return R.to_artifact_json(R.article_columns(assembled(spark, sf), LEVELS, rows=100))


@query(
    "write_artifact",
    f"""WITH {SUMMARIES}, {TOPIC_LABELS}, {NAMES}, {CHUNKS_JSON},
    keywords AS (SELECT 'news, ' || string_agg(replace(name, ' ', ', '), ', ' ORDER BY topic_path) AS keywords FROM names WHERE level = 0)
    SELECT CAST(to_json({{'keywords': keywords}}) AS VARCHAR) AS value, 'header' AS part FROM keywords
    UNION ALL SELECT value, 'articles' FROM chunk_json""",
)
def write_artifact(spark, sf):
    path = new_path(spark, "artifact")
    columns = R.article_columns(assembled(spark, sf), LEVELS, rows=100)
    R.write_artifact(R.topic_keywords(names(spark, sf)), columns, path)
    stored = [spark.read.text(f"{path}/{part}").withColumn("part", F.lit(part)) for part in ("header", "articles")]
    return stored[0].unionByName(stored[1])
