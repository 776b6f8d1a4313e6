"""Registered queries run their operators with the operators' own defaults."""

import inspect

import pytest
from pyspark.sql import functions as F

from topicflow.catalog import models, text, topics

SF = "/root/testdata/sf0.001"


class Called(Exception):
    pass


def defaults_only(function, given):
    """Stands for the operator; fails if a default is given another value."""
    known = inspect.signature(function)

    def call(*args, **options):
        bound = known.bind(*args, **options)
        for name, value in bound.arguments.items():
            default = known.parameters[name].default
            if known.parameters[name].kind is inspect.Parameter.VAR_KEYWORD:
                assert value == {}
            elif default is not inspect.Parameter.empty and name not in given:
                assert value == default, (name, value)
        raise Called

    return call


@pytest.mark.parametrize(
    "module, operator, query, given",
    [
        (models.T, "fit_topic_node", models.fit_topic_node, ()),
        (models.T, "fit_topic_tree", models.fit_topic_tree, ()),
        (models.T, "fit_topic_tree", models.predict_topics, ()),
        (models.T, "fit_topic_tree", models.route_to_child, ()),
        (models.T, "fit_topic_tree", models.extract_topic_features, ()),
        (models.T, "soft_clusters", models.soft_clusters, ("top",)),
        (models.T, "latent_features", models.soft_cluster_tree, ()),
        (text.terms, "fit_word_vectors", text.word2vec, ()),
        (topics, "train_topics", topics.trained, ("fit_on",)),
        (topics, "train_topics", topics.fresh_summaries, ()),
        (topics, "train_topics", topics.report, ()),
    ],
)
def test_queries_keep_the_defaults(spark, monkeypatch, module, operator, query, given):
    monkeypatch.setattr(module, operator, defaults_only(getattr(module, operator), given))
    with pytest.raises(Called):
        query(spark, SF)


def test_word2vec_returns_the_vectors(spark, monkeypatch):
    vectors = spark.createDataFrame([("word", [0.5, 1.5])], "word string, vector array<double>")
    monkeypatch.setattr(text.terms, "fit_word_vectors", lambda *a, **b: vectors)
    assert text.word2vec(spark, SF).select("word", F.col("vector")).collect() == vectors.collect()


def test_level_features_are_as_long_as_the_latent_space(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(models, "_tree", lambda spark, sf: (None, None))
    monkeypatch.setattr(models.T, "extract_topic_features", lambda rows, tree, **options: given.update(options))
    models.extract_topic_features(spark, SF)
    assert given == {"key": "vec_id"}


def test_both_runs_of_ingest_share_the_profiles(spark, monkeypatch):
    from topicflow.catalog import ingest as module

    for name in ("ingest", "pages", "_store", "_stored", "new_path", "KnownUrls"):
        monkeypatch.setattr(module, name, lambda *a, **k: ())
    learned = []
    monkeypatch.setattr(module, "profiles", lambda *a: learned.append(a))
    module.ingested(spark, "sf")
    module.ingested_with_index(spark, "sf")
    assert len(learned) == 2
