import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicflow.functions.vectors import as_array, as_vector
from topicflow.operators import report as R
from topicflow.operators import topics as T
from topicflow.operators.summaries import lead_summarizer, model_summarizer, summarize_topics
from topicflow.operators.groups import calinski_harabasz
from topicflow.plans.ingest import ingest
from topicflow.plans.topics import TopicModel, summarize_fresh, train_topics
from topicflow.operators.lang import fit_language_profiles
from topicflow.sources import store


def lead(text, n=2):
    return " ".join(text.split(".")[:n]).strip()


def brute_topic(rows, b=10):
    """rows: (key, summary) of one path."""
    if len(rows) > b:
        rows = sorted(rows, key=lambda r: (hashlib.md5((r[0] + "45").encode()).hexdigest(), r[0]))
        parts = [list(p) for p in np.array_split(np.arange(len(rows)), b)]
        texts = [lead(". ".join(rows[i][1] for i in p)) for p in parts]
    else:
        texts = [s for _, s in sorted(rows)]
    return lead(". ".join(texts))


@pytest.mark.parametrize("partitions", [1, 6])
def test_topic_summaries_equal_brute_force(spark, partitions):
    sizes = {(0, 0): 10, (0, 1): 11, (1, 0): 23, (2, 0): 1, (3, 0): 200}
    rows = [
        (f"u{l0}-{l1}-{i}", "" if i % 7 == 3 else f"s{i}. t{l0}{l1}. x" if i % 2 else f"only {i}", l0, l1)
        for (l0, l1), n in sizes.items()
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "url string, summary string, l0 int, l1 int").repartition(partitions)
    found = {r.topic_path: r for r in summarize_topics(df, ["l0", "l1"], lead_summarizer()).collect()}
    paths = {}
    for url, summary, l0, l1 in rows:
        for path in (str(l0), f"{l0}_{l1}"):
            paths.setdefault(path, []).append((url, summary))
    assert found.keys() == paths.keys()
    for path, members in paths.items():
        assert found[path].articles == len(members)
        assert found[path].summary == brute_topic(members), path


def test_levels_not_reached_have_no_path(spark):
    df = spark.createDataFrame([("u", "s", 0, None), ("v", "t", 0, 1)], "url string, summary string, l0 int, l1 int")
    found = {r.topic_path: r.articles for r in summarize_topics(df, ["l0", "l1"], lead_summarizer()).collect()}
    assert found == {"0": 2, "0_1": 1}


def test_model_slot_sees_all_texts(spark):
    rows = [(f"u{i:03}", f"s{i}", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "url string, summary string, l0 int")
    count = model_summarizer(lambda texts: texts.str.count(r"\.").astype(str))
    assert summarize_topics(df, ["l0"], count).first().summary == "9"
    longest = model_summarizer(lambda texts: texts.str.split(". ", regex=False).map(lambda t: ". ".join(sorted(t))))
    found = summarize_topics(df, ["l0"], longest, piece_rows=2).first().summary
    assert sorted(found.split(". ")) == [f"s{i}" for i in sorted(range(50), key=str)]


def test_articles_without_a_summary_take_no_place(spark):
    rows = [(f"u{i:03}", None if i % 3 else f"s{i}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "url string, summary string, l0 int")
    full = df.where("summary IS NOT NULL")
    assert summarize_topics(df, ["l0"], lead_summarizer()).collect() == summarize_topics(full, ["l0"], lead_summarizer()).collect()


def test_pieces_of_large_batches(spark):
    rows = [(f"u{i:04}", f"a{i}. b{i}", 0) for i in range(500)]
    df = spark.createDataFrame(rows, "url string, summary string, l0 int")
    order = sorted(rows, key=lambda r: (hashlib.md5((r[0] + "45").encode()).hexdigest(), r[0]))
    texts = []
    for part in np.array_split(np.arange(500), 10):
        level = [order[i][1] for i in part]
        while True:
            level = [lead(". ".join(level[j : j + 7])) for j in range(0, len(level), 7)]
            if len(level) == 1:
                break
        texts += level
    assert summarize_topics(df, ["l0"], lead_summarizer(), piece_rows=7).first().summary == lead(". ".join(texts))


def test_far_points_keep_their_dispersion(spark):
    random = np.random.RandomState(1)
    near = [(i % 3, [float(x) for x in (i % 3) * 0.01 + 0.001 * random.randn(4)]) for i in range(60)]
    score = {}
    for shift in (0.0, 1e6):
        rows = [(label, [x + shift for x in v]) for label, v in near]
        df = spark.createDataFrame(rows, "label int, v array<double>").select("label", as_vector(F.col("v")).alias("features"))
        score[shift] = calinski_harabasz(df).first().score
    assert abs(score[1e6] / score[0.0] - 1) < 1e-3


def test_repeated_urls_neither_multiply_nor_mix(spark, tmp_path):
    texts = [f"{w} {w} talk of {w} and some more {w}" for w in ("apple", "river", "engine")]
    rows = [(f"u{i // 2}", texts[i % 3] + f" {i}. rest", f"2024-01-0{1 + i % 5} 00:00:00") for i in range(24)]
    rows += rows[:2]
    articles = spark.createDataFrame(rows, "url string, content string, parse_datetime string").withColumn("title", F.col("url"))
    words = ["apple", "river", "engine", "talk", "rest"]
    vectors = spark.createDataFrame([(w, [float(i == j) for j in range(5)]) for i, w in enumerate(words)], "word string, vector array<double>")
    model = train_topics(articles, "2024-01-01", word_vectors=vectors, k=3, latent=2, max_iter=5, max_depth=1)
    fresh = summarize_fresh(articles, "2024-01-01", model)
    assert fresh.labels.count() == fresh.summaries.count() == 24
    assembled = R.assemble_articles(fresh.articles, fresh.summaries, fresh.labels, "row")
    assert assembled.count() == 24
    assert {r.url for r in assembled.collect()} == {f"u{i}" for i in range(12)}
    by_url = R.assemble_articles(fresh.articles, fresh.summaries.join(fresh.articles, "row").drop("row"), fresh.labels.join(fresh.articles, "row").drop("row"))
    assert by_url.count() == 12
    model.save(spark, str(tmp_path / "model"))
    again = summarize_fresh(articles, "2024-01-01", TopicModel.load(spark, str(tmp_path / "model")))
    assert sorted(map(tuple, again.labels.collect())) == sorted(map(tuple, fresh.labels.collect()))


def blobs(spark, n=40, centers=((5, 0, 0, 0), (0, 5, 0, 0), (0, 0, 5, 0))):
    random = np.random.RandomState(0)
    rows = [(f"u{i}", [float(x) for x in np.array(centers[i % len(centers)]) + 0.3 * random.randn(4)]) for i in range(n * len(centers))]
    return spark.createDataFrame(rows, "url string, v array<double>").select("url", as_vector(F.col("v")).alias("features"))


def test_tree_labels_every_row_once(spark, tmp_path):
    df = blobs(spark)
    tree = T.fit_topic_tree(df, 2, k=6, latent=3, max_iter=10)
    labels = T.predict_topics(df, tree).toPandas()
    assert sorted(labels.url) == sorted(r.url for r in df.select("url").collect())
    assert labels.l0.notna().all()
    tops = sorted(set(labels.l0))
    assert tops == list(range(len(tops)))
    assert set(tree.children) == set(tops)
    tree.save(spark, str(tmp_path / "tree"))
    again = T.predict_topics(df, T.TopicTree.load(spark, str(tmp_path / "tree"))).toPandas()
    key = ["url"]
    assert labels.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    width = T.extract_topic_features(df, tree, 3).select(F.size("features")).distinct().collect()
    assert [r[0] for r in width] == [6]


def test_few_rows_make_one_topic(spark):
    df = blobs(spark, 3)
    node = T.fit_topic_node(df, k=20)
    assert node.constant == 0
    assert {r.topic for r in node.predict(df).collect()} == {0}


def test_soft_clusters_sum_to_one(spark):
    df = blobs(spark)
    rows = T.soft_clusters(df, 3).collect()
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
    kept = T.soft_clusters(df, 3, top=1).collect()
    assert all(sorted(r.probabilities) == [0.0, 0.0, 1.0] and r.probabilities[r.label] == 1.0 for r in kept)
    copies = spark.createDataFrame([(f"u{i}", [1.0, 1.0]) for i in range(30)], "url string, v array<double>")
    copies = copies.select("url", as_vector(F.col("v")).alias("features"))
    assert T.soft_clusters(copies, 2).count() == 30


def test_soft_tree_paths(spark):
    found = T.soft_cluster_tree(blobs(spark), [3, 2]).toPandas()
    assert len(found) == 120 and (found.topic_path == found.l0.astype(str) + "_" + found.l1.astype(str)).all()
    order = {p: i for i, p in enumerate(sorted(set(found.topic_path)))}
    assert (found.code == found.topic_path.map(order)).all()


def test_choose_k(spark):
    found = {r.k: r.best for r in T.choose_k(blobs(spark), [2, 3, 8]).collect()}
    assert found == {2: False, 3: True, 8: False}


def test_edges_of_one_level_point_to_themselves(spark):
    labels = spark.createDataFrame([(0, None), (1, 0), (1, 1)], "l0 int, l1 int")
    names = spark.createDataFrame([(p, p.upper() + "!") for p in ("0", "1", "1_0", "1_1")], "topic_path string, name string")
    found = {tuple(r) for r in R.topic_edges(labels, names, ["l0", "l1"]).collect()}
    assert found == {("0!", "0!"), ("1!", "1_0!"), ("1!", "1_1!")}


def test_article_chunks_give_the_shuffled_list(spark):
    rows = [(f"u{i}", f"s{i}", i % 2, 0) for i in range(95)]
    df = spark.createDataFrame(rows, "url string, summary string, l0 int, l1 int")
    chunks = R.article_columns(df, ["l0", "l1"], rows=10).orderBy("chunk").collect()
    urls = [u for c in chunks for u in c.url]
    assert len(chunks) > 5
    assert urls == sorted((r[0] for r in rows), key=lambda u: hashlib.md5((u + "45").encode()).hexdigest())
    assert [s for c in chunks for s in c.summary] == ["s" + u[1:] for u in urls]


def test_ingest_twice_adds_nothing(spark, tmp_path):
    page = lambda text: f"<title>t</title><article>{text}</article>"
    pages = [("a", page("the cat and the dog")), ("b", page("copy of the text")), ("c", page("copy of the text")),
             ("d", page("")), ("e", page("der hund und die katze"))]
    df = spark.createDataFrame(pages, "url string, html string")
    labelled = spark.createDataFrame(
        [("en", "the cat and the dog of the house"), ("de", "der hund und die katze im haus")], "lang string, content string"
    )
    profiles = fit_language_profiles(labelled, ["de", "en"])
    paths = str(tmp_path / "articles"), str(tmp_path / "rejected")
    store.ensure_tables(spark, *paths)
    for _ in range(2):
        ingest(df, *paths, profiles, ["de", "en"])
    assert [r.url for r in store.read_articles(spark, paths[0]).collect()] == ["a"]
    assert sorted(r.url for r in store.read_rejected(spark, paths[1]).collect()) == ["b", "c", "d"]
    ingest(df, *paths, profiles, ["de", "en"], reject_language=True)
    assert sorted(r.url for r in store.read_rejected(spark, paths[1]).collect()) == ["b", "c", "d", "e"]
