"""Centroids, distances, thresholds, merges, samples and label encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, euclidean_distance, topk_renormalize
from ..operators import distances as D
from ..operators import groups as G
from ..operators import merge as M
from ..operators import sampling as S
from .base import (
    ARTICLES,
    CENTROIDS,
    DISTANCES,
    DOC_VECTORS,
    EMB,
    LEVELS,
    PATHS,
    SIZES,
    TOPIC_LABELS,
    articles,
    bins_sql,
    closure_sql,
    embeddings,
    overlap_sql,
    query,
    staged_texts,
    table,
    topic_labels,
)
from .text import hash_vectorizer


@query("centroids", f"WITH {CENTROIDS} SELECT label, CAST(dim AS INTEGER) AS dim, round(x, 6) AS x FROM centers")
def centroids(spark, sf):
    long = G.centroids(embeddings(spark, sf)).select("label", F.posexplode("centroid").alias("dim", "x"))
    return long.select("label", "dim", F.round("x", 6).alias("x"))


@query("cluster_sizes", f"WITH {SIZES} SELECT label, size, round(size / max(size) OVER (), 6) AS relative FROM sizes")
def cluster_sizes(spark, sf):
    return G.cluster_sizes(embeddings(spark, sf)).withColumn("relative", F.round("relative", 6))


def _distances(spark, sf, metric="cosine"):
    return D.pairwise_distances(G.centroids(embeddings(spark, sf)), metric)


@query("pairwise_distances_cosine", f"WITH {DISTANCES} SELECT a, b, round(dist, 6) AS dist FROM distances")
def pairwise_cosine(spark, sf):
    return _distances(spark, sf).withColumn("dist", F.round("dist", 6))


@query(
    "pairwise_distances_euclidean",
    f"""WITH {CENTROIDS} SELECT a.label AS a, b.label AS b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS dist
    FROM centers a JOIN centers b USING (dim) WHERE a.label <> b.label GROUP BY a.label, b.label""",
)
def pairwise_euclidean(spark, sf):
    return _distances(spark, sf, "euclidean").withColumn("dist", F.round("dist", 6))


@query(
    "vector_distances",
    f"""WITH {EMB}, ones AS (SELECT vec_id, x, CASE WHEN dim % 2 = 0 THEN 1.0 ELSE 0.5 END AS y FROM emb)
    SELECT vec_id, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine,
        round(sqrt(sum((x - y) * (x - y))), 6) AS euclidean FROM ones GROUP BY vec_id""",
)
def vector_distances(spark, sf):
    a = F.col("embedding").cast("array<double>")
    b = F.transform(a, lambda x, i: F.when(i % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.5)))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(cosine_distance(a, b), 6).alias("cosine"), F.round(euclidean_distance(a, b), 6).alias("euclidean")
    )


@query("close_pairs", f"WITH {DISTANCES} SELECT a, b, round(dist, 6) AS dist FROM distances WHERE dist <= 0.9")
def close_pairs(spark, sf):
    return D.close_pairs(_distances(spark, sf), 0.9).withColumn("dist", F.round("dist", 6))


@query(
    "quantile_bins",
    f"""WITH {DISTANCES}, {SIZES}, {bins_sql('d', 'distances', 'dist')}, {bins_sql('s', 'sizes', 'size')}
    SELECT 'dist' AS kind, bin, round("left", 9) AS "left", round("right", 9) AS "right" FROM d_bins
    UNION ALL SELECT 'size', bin, round("left", 9), round("right", 9) FROM s_bins""",
)
def quantile_bins(spark, sf):
    by_distance = G.quantile_bins(_distances(spark, sf), "dist").withColumn("kind", F.lit("dist"))
    by_size = G.quantile_bins(G.cluster_sizes(embeddings(spark, sf)), "size").withColumn("kind", F.lit("size"))
    both = by_distance.unionByName(by_size)
    return both.select("kind", "bin", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"))


@query(
    "largest_gap_threshold",
    f"""WITH {DISTANCES}, {SIZES}, {bins_sql('d', 'distances', 'dist')}, {bins_sql('s', 'sizes', 'size')}
    SELECT 'dist' AS kind, round(ratio, 6) AS ratio, round(threshold, 9) AS threshold FROM d_gap
    UNION ALL SELECT 'size', round(ratio, 6), round(threshold, 9) FROM s_gap""",
)
def largest_gap_threshold(spark, sf):
    parts = []
    for kind, rows, column in (
        ("dist", _distances(spark, sf), "dist"),
        ("size", G.cluster_sizes(embeddings(spark, sf)), "size"),
    ):
        gap = G.largest_gap_threshold(G.quantile_bins(rows, column))
        parts.append(
            gap.select(F.lit(kind).alias("kind"), F.round("ratio", 6).alias("ratio"), F.round("threshold", 9).alias("threshold"))
        )
    return parts[0].unionByName(parts[1])


@query(
    "calinski_harabasz",
    f"""WITH {CENTROIDS}, {SIZES}, mean AS (SELECT dim, avg(x) AS m FROM emb GROUP BY dim),
    within AS (SELECT sum((e.x - c.x) * (e.x - c.x)) AS w FROM emb e JOIN centers c USING (label, dim)),
    between_ AS (SELECT sum(size * (c.x - m) * (c.x - m)) AS b FROM centers c JOIN sizes USING (label) JOIN mean USING (dim)),
    counts AS (SELECT count(*) AS n, count(DISTINCT label) AS k FROM embeddings)
    SELECT k AS clusters, round((b / (k - 1)) / (w / (n - k)), 6) AS score FROM within, between_, counts""",
)
def calinski_harabasz(spark, sf):
    return G.calinski_harabasz(embeddings(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "nearest_topic",
    f"""WITH {DISTANCES} SELECT a, arg_min(b, (dist, b)) AS b, round(min(dist), 6) AS dist,
        a || ' | ' || arg_min(b, (dist, b)) AS name FROM distances GROUP BY a""",
)
def nearest_topic(spark, sf):
    return D.nearest_topic(_distances(spark, sf)).withColumn("dist", F.round("dist", 6))


NEAREST_BIG = f"""{DISTANCES}, {SIZES}, {bins_sql('s', 'sizes', 'size')},
big_pairs AS (SELECT d.a, arg_min(d.b, (d.dist, d.b)) AS b FROM distances d
    JOIN sizes sa ON sa.label = d.a JOIN sizes sb ON sb.label = d.b, s_gap
    WHERE sa.size <= threshold AND sb.size > threshold GROUP BY d.a)"""


@query("nearest_big_cluster", f"WITH {NEAREST_BIG} SELECT a, b FROM big_pairs")
def nearest_big_cluster(spark, sf):
    sizes = G.cluster_sizes(embeddings(spark, sf))
    threshold = G.largest_gap_threshold(G.quantile_bins(sizes, "size")).first().threshold
    return D.nearest_big_cluster(sizes, _distances(spark, sf), threshold)


def _merged_by_distance(groups: str) -> str:
    return f"""WITH RECURSIVE {DISTANCES}, {SIZES}, {bins_sql('d', 'distances', 'dist')},
pairs AS (SELECT a, b FROM distances, d_gap WHERE dist <= threshold), {groups}
SELECT vec_id, new_label AS label FROM embeddings JOIN mapping USING (label)"""


@query("merge_by_distance_closure", _merged_by_distance(closure_sql("sizes", "pairs")))
def merge_by_distance_closure(spark, sf):
    return M.merge_by_distance(embeddings(spark, sf), rule="closure").select("vec_id", "label")


@query("merge_by_distance", _merged_by_distance(overlap_sql("sizes", "pairs")))
def merge_by_distance(spark, sf):
    return M.merge_by_distance(embeddings(spark, sf)).select("vec_id", "label")


@query(
    "merge_by_size",
    f"""WITH RECURSIVE {NEAREST_BIG}, {closure_sql('sizes', 'big_pairs')}
    SELECT vec_id, new_label AS label FROM embeddings JOIN mapping USING (label)""",
)
def merge_by_size(spark, sf):
    return M.merge_by_size(embeddings(spark, sf)).select("vec_id", "label")


MERGE_PAIRS = "pairs AS (SELECT a, b FROM distances WHERE dist <= 0.85)"


@query(
    "merge_labels_closure",
    f"WITH RECURSIVE {DISTANCES}, {SIZES}, {MERGE_PAIRS}, {closure_sql('sizes', 'pairs')} SELECT label, new_label FROM mapping",
)
def merge_labels_closure(spark, sf):
    pairs = D.close_pairs(_distances(spark, sf), 0.85)
    return M.merge_labels(embeddings(spark, sf).select("label"), pairs, "closure")


@query(
    "merge_labels_overlap",
    f"WITH RECURSIVE {DISTANCES}, {SIZES}, {MERGE_PAIRS}, {overlap_sql('sizes', 'pairs')} SELECT label, new_label FROM mapping",
)
def merge_labels_overlap(spark, sf):
    pairs = D.close_pairs(_distances(spark, sf), 0.85)
    return M.merge_labels(embeddings(spark, sf).select("label"), pairs, "overlap")


@query(
    "top_words",
    f"""WITH {DOC_VECTORS}, {TOPIC_LABELS}, centers AS (
        SELECT l0 AS label, avg(v1) AS c1, avg(v2) AS c2, avg(v3) AS c3, avg(v4) AS c4
        FROM doc_vectors JOIN topic_labels USING (url) GROUP BY l0),
    scored AS (SELECT label, token AS word, (c1 * v1 + c2 * v2 + c3 * v3 + c4 * v4)
        / (sqrt(c1 * c1 + c2 * c2 + c3 * c3 + c4 * c4) * sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4)) AS similarity
        FROM centers, wv)
    SELECT label, CAST(rn AS INTEGER) AS rn, word, round(similarity, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 9) DESC, word) AS rn FROM scored)
    WHERE rn <= 5""",
)
def top_words(spark, sf):
    texts = staged_texts(spark, sf)
    vectorizer = hash_vectorizer(texts)
    vectors = vectorizer.transform_cleaned(texts)
    labelled = vectors.join(topic_labels(spark, sf), "url").withColumn("label", F.col("l0"))
    words = D.top_words(G.centroids(labelled), vectorizer.word_vectors)
    return words.withColumn("similarity", F.round("similarity", 6))


@query(
    "topk_renormalize",
    f"""WITH {EMB}, probs AS (SELECT vec_id, dim, abs(x) / sum(abs(x)) OVER (PARTITION BY vec_id) AS p FROM emb),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, dim) AS rn FROM probs)
    SELECT vec_id, CAST(dim AS INTEGER) AS dim,
        round(CASE WHEN rn <= 5 THEN p / sum(CASE WHEN rn <= 5 THEN p END) OVER (PARTITION BY vec_id) ELSE 0 END, 6) AS p
    FROM ranked""",
)
def topk_probabilities(spark, sf):
    sizes = F.transform(F.col("embedding").cast("array<double>"), F.abs)
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    rows = table(spark, sf, "embeddings").select("vec_id", sizes.alias("s"), total.alias("t"))
    rows = rows.select("vec_id", F.transform("s", lambda x: x / F.col("t")).alias("p"))
    kept = rows.select("vec_id", F.posexplode(topk_renormalize(F.col("p"), 5)).alias("dim", "p"))
    return kept.withColumn("p", F.round("p", 6))


@query("relabel", "SELECT vec_id, CASE WHEN label % 2 = 0 THEN label / 2 ELSE label END :: INTEGER AS label FROM embeddings")
def relabel(spark, sf):
    labels = embeddings(spark, sf).select("vec_id", "label")
    mapping = labels.where("label % 2 = 0").select("label", (F.col("label") / 2).cast("int").alias("new_label")).distinct()
    return G.relabel(labels, mapping)


@query(
    "dense_relabel",
    "SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label * 7 + 3) - 1 AS INTEGER) AS label FROM embeddings",
)
def dense_relabel(spark, sf):
    return G.dense_relabel(embeddings(spark, sf).select("vec_id", (F.col("label") * 7 + 3).alias("label")))


@query(
    "encode_paths",
    f"""WITH {TOPIC_LABELS} SELECT url, l0 || '_' || l1 AS topic_path,
        CAST(dense_rank() OVER (ORDER BY l0 || '_' || l1) - 1 AS INTEGER) AS code FROM topic_labels""",
)
def encode_paths(spark, sf):
    paths = topic_labels(spark, sf).select("url", G.topic_path(LEVELS, 1).alias("topic_path"))
    return G.encode_paths(paths)


@query("topic_path", f"WITH {TOPIC_LABELS}, {PATHS} SELECT url, CAST(level AS INTEGER) AS level, topic_path FROM paths")
def topic_paths(spark, sf):
    return G.explode_paths(topic_labels(spark, sf), LEVELS, "url")


@query("default_topic_names", f"WITH {TOPIC_LABELS} SELECT DISTINCT l1 AS label, '1_' || l1 AS name FROM topic_labels")
def default_topic_names(spark, sf):
    return G.default_topic_names(topic_labels(spark, sf).withColumn("label", F.col("l1")), 1, "label")


@query("rows_of_topic", f"WITH {TOPIC_LABELS} SELECT url, l0, l1 FROM topic_labels WHERE l0 || '_' || l1 = '2_1'")
def rows_of_topic(spark, sf):
    return G.rows_of_topic(topic_labels(spark, sf), LEVELS, "2_1")


@query("topic_ints", f"WITH {TOPIC_LABELS} SELECT url, l0, l1 FROM topic_labels")
def topic_ints(spark, sf):
    floats = topic_labels(spark, sf).withColumns({c: F.col(c).cast("double") for c in LEVELS})
    return G.as_topic_ints(floats, LEVELS)


@query(
    "topic_rollup",
    f"""WITH {ARTICLES}, {TOPIC_LABELS}, {PATHS} SELECT CAST(level AS INTEGER) AS level, topic_path, count(*) AS articles,
        CAST(sum(length(content)) AS BIGINT) AS letters FROM paths JOIN articles USING (url) GROUP BY level, topic_path""",
)
def topic_rollup(spark, sf):
    rows = articles(spark, sf).select("url", F.length("content").alias("n")).join(topic_labels(spark, sf), "url")
    return G.topic_rollup(rows, LEVELS, F.count("*").alias("articles"), F.sum("n").alias("letters"))


@query(
    "topic_counts",
    f"""WITH {TOPIC_LABELS} SELECT count(url) AS articles, count(DISTINCT l0) AS topics_0,
        count(DISTINCT l0 || '_' || l1) AS topics_1 FROM topic_labels""",
)
def topic_counts(spark, sf):
    return G.topic_counts(topic_labels(spark, sf), LEVELS)


@query(
    "join_strings",
    "SELECT conv_id, string_agg(text, '. ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id",
)
def join_strings(spark, sf):
    return G.join_strings(table(spark, sf, "conversations"), ["conv_id"], "turn", "text", ". ")


@query("shuffle_rows", f"WITH {ARTICLES} SELECT url, md5(url || '45') AS place FROM articles")
def shuffle_rows(spark, sf):
    shuffled = S.shuffle_rows(articles(spark, sf).select("url"))
    return shuffled.withColumn("place", F.md5(F.concat("url", F.lit("45"))))


@query(
    "sample_at_most",
    f"WITH {ARTICLES} SELECT url FROM articles ORDER BY md5(url || '45'), url LIMIT 300",
)
def sample_at_most(spark, sf):
    return S.sample_at_most(articles(spark, sf).select("url"), 300)


@query(
    "sample_per_topic",
    f"""WITH {TOPIC_LABELS} SELECT url, l0, CAST(rn AS INTEGER) AS rn FROM (
        SELECT url, l0, row_number() OVER (PARTITION BY l0 ORDER BY md5(url || l0), url) AS rn FROM topic_labels)
    WHERE rn <= 10""",
)
def sample_per_topic(spark, sf):
    return S.sample_per_topic(topic_labels(spark, sf)).select("url", "l0", "rn")


@query(
    "stratified_sample",
    f"""WITH {TOPIC_LABELS} SELECT url, topic_path, CAST(rn AS INTEGER) AS rn FROM (
        SELECT url, l0 || '_' || l1 AS topic_path,
            row_number() OVER (PARTITION BY l0, l1 ORDER BY md5(url || '45'), url) AS rn FROM topic_labels)
    WHERE rn <= 20""",
)
def stratified_sample(spark, sf):
    return S.stratified_sample(topic_labels(spark, sf), LEVELS).select("url", "topic_path", "rn")


@query(
    "summary_batches",
    f"""WITH {TOPIC_LABELS} SELECT url, l0,
        CAST(ntile(10) OVER (PARTITION BY l0 ORDER BY md5(url || '45'), url) AS INTEGER) AS batch FROM topic_labels""",
)
def summary_batches(spark, sf):
    return S.summary_batches(topic_labels(spark, sf), ["l0"]).select("url", "l0", "batch")
