"""Training, labelling, summaries, report and artifact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import distinct_texts, fresh_since, with_row_key
from ..operators.report import (
    FIXED_KEYWORDS,
    article_columns,
    artifact_header,
    assemble_articles,
    topic_edges,
    topic_names,
    write_artifact,
)
from ..operators.summaries import Summarizer, lead_summarizer, summarize, summarize_topics
from ..operators.terms import TextVectorizer, fit_vectorizer
from ..operators.topics import TopicTree, fit_topic_tree, predict_topics
from ..session import materialize


@dataclass
class TopicModel:
    vectorizer: TextVectorizer
    tree: TopicTree

    @property
    def levels(self) -> list[str]:
        return [f"l{i}" for i in range(self.tree.depth)]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model for later runs; they label with it without training."""
        self.vectorizer.save(f"{path}/vectorizer")
        self.tree.save(spark, f"{path}/tree")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        return cls(TextVectorizer.load(spark, f"{path}/vectorizer"), TopicTree.load(spark, f"{path}/tree"))


def train_topics(
    articles: DataFrame,
    since: str,
    fit_on: str = "fresh",
    max_depth: int = 2,
    lemmas: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    word2vec: dict[str, int] | None = None,
    **options: int,
) -> TopicModel:
    """Fit the vectorizer on fresh or all distinct texts and the topic tree on the fresh ones.

    The texts are distinct, so a text is its own key; a hash of it is shorter to shuffle.
    """
    keyed = lambda df: distinct_texts(df, ordered=False).select(F.sha2("content", 256).alias("url"), "content")
    fresh = materialize(keyed(fresh_since(articles, since)), name="fresh")
    corpus = fresh if fit_on == "fresh" else keyed(articles)
    vectorizer = fit_vectorizer(corpus, lemmas=lemmas, word_vectors=word_vectors, **(word2vec or {}))
    features = materialize(vectorizer.transform(fresh), name="features")
    return TopicModel(vectorizer, fit_topic_tree(features, max_depth, **options))


@dataclass
class FreshSummaries:
    """Tables of the fresh articles by ``row`` (see ``with_row_key``), and the topics' summaries."""

    articles: DataFrame
    features: DataFrame
    labels: DataFrame
    summaries: DataFrame
    topic_summaries: DataFrame


def summarize_fresh(
    articles: DataFrame,
    since: str,
    model: TopicModel,
    summarizer: Summarizer | None = None,
    ready_summaries: DataFrame | None = None,
) -> FreshSummaries:
    """Label every fresh article, summarize it, then summarize each topic at each level.

    ``ready_summaries`` are (row, summary).  An article is known by its row key, so that articles
    that share a url neither multiply nor mix.
    """
    summarizer = summarizer or lead_summarizer()
    fresh = materialize(with_row_key(fresh_since(articles, since)).select("row", "url", "content"), name="fresh")
    features = materialize(model.vectorizer.transform(fresh, "row"), name="features")
    labels = materialize(predict_topics(features, model.tree, "row"), name="labels")
    summaries = ready_summaries
    if summaries is None:
        summaries = materialize(summarize(fresh, summarizer, "row"), name="summaries")
    topics = summarize_topics(summaries.join(labels, "row"), model.levels, summarizer, key="row")
    return FreshSummaries(fresh.select("row", "url"), features, labels, summaries, materialize(topics, name="topics"))


def topic_report(fresh: FreshSummaries, model: TopicModel) -> tuple[DataFrame, DataFrame]:
    """((level, topic_path, articles, name, summary), (parent, child))."""
    names = materialize(
        topic_names(fresh.features, fresh.labels, model.levels, model.vectorizer.word_vectors, "row"), name="names"
    )
    report = names.join(fresh.topic_summaries, ["level", "topic_path"]).select(
        "level", "topic_path", "articles", "name", "summary"
    )
    return report, topic_edges(fresh.labels, names, model.levels)


def build_artifact(
    articles: DataFrame,
    summaries: DataFrame,
    labels: DataFrame,
    topic_summaries: DataFrame,
    names: DataFrame,
    sources: DataFrame,
    since: str,
    levels: Sequence[str],
    path: str,
    keywords: Sequence[str] = FIXED_KEYWORDS,
) -> None:
    """Write the artifact of the fresh articles; summaries and labels are keyed by ``row`` or, from
    stores where urls are unique, by url."""
    fresh = fresh_since(articles, since)
    key = "row" if "row" in summaries.columns else "url"
    fresh = with_row_key(fresh) if key == "row" else fresh
    assembled = materialize(assemble_articles(fresh, summaries, labels, key), name="assembled")
    header = artifact_header(assembled, topic_summaries, names, sources, F.lit(since).cast("timestamp"), keywords=keywords)
    write_artifact(header, article_columns(assembled, levels), path)
