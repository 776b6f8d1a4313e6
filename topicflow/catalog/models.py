"""Model operators."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.vectors import as_array
from ..operators import topics as T
from ..session import materialize, new_path
from .base import embeddings, query


def vectors(spark, sf):
    return materialize(embeddings(spark, sf), name="vectors")


@query("cluster")
def cluster(spark, sf):
    return T.cluster(embeddings(spark, sf).drop("label"), 20).select("vec_id", "label")


@query("single_topic", "SELECT vec_id, 0 AS label FROM embeddings")
def single_topic(spark, sf):
    return T.single_topic(embeddings(spark, sf).select("vec_id"))


@query("latent_features")
def latent_features(spark, sf):
    return T.latent_features(embeddings(spark, sf)).select("vec_id", "latent")


@query("topic_classifier")
def topic_classifier(spark, sf):
    scored = T.topic_classifier(T.latent_features(vectors(spark, sf)))
    return scored.select("vec_id", "label", "topic", "scores")


@query("fit_topic_node")
def fit_topic_node(spark, sf):
    rows = vectors(spark, sf)
    return T.fit_topic_node(rows).predict(rows).select("vec_id", "topic")


def _tree(spark, sf):
    rows = vectors(spark, sf)
    return rows, T.fit_topic_tree(rows)


@query("fit_topic_tree")
def fit_topic_tree(spark, sf):
    _, tree = _tree(spark, sf)
    nodes = [(path, node.topic_count) for path, node in tree.nodes().items()]
    return spark.createDataFrame(nodes, "topic_path string, topics int")


@query("predict_topics")
def predict_topics(spark, sf):
    rows, tree = _tree(spark, sf)
    path = new_path(spark, "tree")
    tree.save(spark, path)
    return T.predict_topics(rows, T.TopicTree.load(spark, path), "vec_id")


@query("route_to_child")
def route_to_child(spark, sf):
    rows, tree = _tree(spark, sf)
    return T.predict_topics(rows, tree, "vec_id").groupBy("l0", "l1").agg(F.count("*").alias("rows"))


@query("extract_topic_features")
def extract_topic_features(spark, sf):
    rows, tree = _tree(spark, sf)
    return T.extract_topic_features(rows, tree, key="vec_id")


@query(
    "concat_level_features",
    """SELECT vec_id, CAST(i AS INTEGER) AS dim, round(x, 6) AS x FROM (
        SELECT vec_id, unnest(pair) AS x, generate_subscripts(pair, 1) - 1 AS i
        FROM (SELECT vec_id, list_concat(embedding :: DOUBLE[], embedding :: DOUBLE[]) AS pair FROM embeddings))""",
)
def concat_level_features(spark, sf):
    one = as_array(F.col("features"))
    rows = embeddings(spark, sf).select("vec_id", one.alias("latent_0"), one.alias("latent_1"))
    both = T.concat_level_features(rows, ["latent_0", "latent_1"], "vec_id")
    return both.select("vec_id", F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query("choose_k")
def choose_k(spark, sf):
    return T.choose_k(vectors(spark, sf).select("features"), [5, 10, 20])


@query("soft_clusters")
def soft_clusters(spark, sf):
    soft = T.soft_clusters(embeddings(spark, sf).drop("label"), 5, top=2)
    return soft.select("vec_id", "label", "probabilities")


@query("soft_cluster_tree")
def soft_cluster_tree(spark, sf):
    latent = T.latent_features(vectors(spark, sf)).select("vec_id", array_to_vector("latent").alias("features"))
    return T.soft_cluster_tree(latent, [3, 2], "vec_id")


@query("project_2d")
def project_2d(spark, sf):
    points, centers = T.project_2d(vectors(spark, sf), key="vec_id")
    return points.join(centers.select("label", F.col("x").alias("center_x"), F.col("y").alias("center_y")), "label")
