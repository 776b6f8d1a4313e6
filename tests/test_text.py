import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicflow.functions import text as X
from topicflow.functions.vectors import as_array
from topicflow.operators import terms
from topicflow.operators.lang import detect_language, fit_language_profiles, select_language
from topicflow.operators.summaries import extractive_summary
from topicflow.sources.pages import discover_urls, extract_articles


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, cleaned",
    [("Hello,  World!\n2x", "hello world x"), ("ёлка Été", "лка t"), ("...", ""), ("Ж\t ы", "ж ы")],
)
def test_clean_text(spark, text, cleaned):
    assert one(spark, text, X.clean_text) == cleaned


def test_preprocess_to_stub(spark):
    assert one(spark, "The and of 123", X.preprocess) == X.STUB
    assert one(spark, "The howev cat", X.preprocess) == "cat"


@pytest.mark.parametrize("text, lead", [("a. b. c", "a  b"), ("a", "a"), ("a.", "a"), ("\n a. b.", "a  b")])
def test_lead_summary(spark, text, lead):
    assert one(spark, text, X.lead_summary) == lead


def test_first_sentences(spark):
    assert one(spark, 'One. Two! "Three?" Four. Five', X.first_sentences) == 'One. Two! "Three?"'
    assert one(spark, "3.5 is a number. Yes", lambda c: X.first_sentences(c, 1)) == "3.5 is a number."


def test_fold_characters(spark):
    assert one(spark, "Äpfel, Щука, naïve, ß", X.fold_characters) == "Aepfel, Schuka, naive, ss"
    # a key of several characters never matches
    assert one(spark, "abc", lambda c: X.fold_characters(c, {"ab": "x", "c": "yz"})) == "abyz"
    for text in ("axc", "axc\ue000\ue001"):
        for mapping in ({"a": "bc", "c": "xy"}, {"x": "a", "a": "bb"}, {"x": "", "c": "\ue000z"}, {"\ue000": "c", "c": "dd"}):
            expected = "".join(mapping.get(c, c) for c in text)
            assert one(spark, text, lambda c: X.fold_characters(c, mapping)) == expected


def test_wrap_and_capitalize(spark):
    assert one(spark, "a.b.", X.wrap_summary) == "a.\nb.\n"
    assert one(spark, "abc", X.capitalize_sentence) == "Abc."


def test_extract_articles(spark):
    html = (
        "<title>A &amp; B</title><nav><a href='/x#top'>n</a><a href='mailto:a@b'>m</a><a href=\"//c.org/z\">z</a></nav>"
        "<article><p>One<br>two &quot;q&quot;</p><script>no()</script></article>"
    )
    pages = spark.createDataFrame([("http://S.org/p", html), ("http://s.org/q", "<article> </article>")], "url string, html string")
    rows = {r.url: r for r in extract_articles(pages, F.lit("2024-01-01")).collect()}
    assert (rows["http://S.org/p"].title, rows["http://S.org/p"].content) == ("A & B", 'One two "q"')
    assert rows["http://s.org/q"].content is None and rows["http://s.org/q"].title is None
    assert {tuple(r) for r in discover_urls(pages).collect()} == {("http://s.org", "http://S.org/x"), ("http://s.org", "http://c.org/z")}


TEXTS = [("d1", "red red fish swims"), ("d2", "blue fish"), ("d3", "the of"), ("d4", "unseen words"), ("d5", "red blue a")]
VECTORS = {"red": [1.0, 0.0], "fish": [0.0, 2.0], "blue": [3.0, 1.0]}


def brute_vectors(use_tfidf=True):
    docs = {u: [w for w in t.split() if w not in X.STOP_WORDS] for u, t in TEXTS}
    df = {}
    for words in docs.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    idf = {w: np.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}
    out = {}
    for u, words in docs.items():
        weights = {w: words.count(w) * idf[w] for w in set(words)}
        norm = np.sqrt(sum(x * x for x in weights.values())) or 1.0
        used = [np.array(VECTORS[w]) * (weights[w] / norm if use_tfidf else 1.0) for w in words if w in VECTORS]
        out[u] = np.mean(used, axis=0) if used else np.zeros(2)
    return out


@pytest.mark.parametrize("use_tfidf", [True, False])
@pytest.mark.parametrize("broadcast_bytes", [terms.BROADCAST_BYTES, 0])
def test_doc_vectors_equal_brute_force(spark, monkeypatch, use_tfidf, broadcast_bytes):
    """Broadcast or joined vocabulary, any number of partitions; zero vector iff no known word."""
    monkeypatch.setattr(terms, "BROADCAST_BYTES", broadcast_bytes)
    df = spark.createDataFrame(TEXTS, "url string, content string").repartition(3)
    wv = spark.createDataFrame(list(VECTORS.items()), "word string, vector array<double>")
    vectorizer = terms.fit_vectorizer(df, word_vectors=wv)
    vectorizer.use_tfidf = use_tfidf
    rows = vectorizer.transform(df).select("url", as_array(F.col("features")).alias("v")).collect()
    found = {r.url: r.v for r in rows}
    expected = brute_vectors(use_tfidf)
    assert found.keys() == expected.keys()
    for url, v in expected.items():
        assert np.allclose(found[url], v), url


@pytest.mark.parametrize("use_tfidf", [True, False])
def test_frequent_words_are_added_where_the_document_is(spark, monkeypatch, use_tfidf):
    """Two words broadcast, the others joined; documents are sorted by no vector, repeated keys are one row."""
    monkeypatch.setattr(terms, "HEAD_BYTES", 2 * (8 * 3 + 24))
    random = np.random.default_rng(3)
    texts = [(f"d{i}", " ".join(f"w{int(w)}" for w in random.zipf(1.4, 12) % 40)) for i in range(300)]
    df = spark.createDataFrame(texts, "url string, content string").selectExpr("url", "content AS cleaned")
    vectors = {f"w{i}": [0.1 * i, 1.0, -0.3 * i] for i in range(0, 40, 2)}
    wv = spark.createDataFrame(list(vectors.items()), "word string, vector array<double>")
    idf = terms.inverse_doc_freq(terms.term_counts(df), df)
    vocabulary = wv.withColumnRenamed("word", "token").join(idf.select("token", "idf", "df"), "token", "full_outer")
    vectorizer = terms.TextVectorizer(vocabulary, 3, vocabulary.count(), use_tfidf=use_tfidf)
    twice = df.unionByName(df.where("url IN ('d1', 'd2')"))
    made = vectorizer.transform_cleaned(twice)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and len(vectorizer._head().value[0]) == 2
    found = {r.url: r.v for r in made.select("url", as_array(F.col("features")).alias("v")).collect()}
    weights = {r.token: r.idf for r in idf.collect()}
    assert len(found) == 300
    for url, text in texts:
        words = text.split() * (2 if url in ("d1", "d2") else 1)
        once = text.split()
        norm = np.sqrt(sum((once.count(w) * weights[w]) ** 2 for w in set(once)) * (len(words) / len(once)))
        scale = {w: once.count(w) * weights[w] / norm if use_tfidf else 1.0 for w in set(once)}
        used = [np.array(vectors[w]) * scale[w] for w in words if w in vectors]
        assert np.allclose(found[url], np.mean(used, axis=0) if used else np.zeros(3)), url


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_tfidf_is_the_same_by_broadcast_and_by_shuffle(spark, threshold):
    df = spark.createDataFrame(TEXTS, "url string, content string")
    cleaned = terms.preprocess_texts(df)
    tf = terms.term_counts(cleaned)
    idf = terms.inverse_doc_freq(tf, cleaned)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = {(r.url, r.token): round(r.w, 9) for r in terms.tfidf(tf, idf).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    norms = {}
    for (url, _), w in found.items():
        norms[url] = norms.get(url, 0) + w * w
    assert found["d2", "blue"] > 0 and all(abs(n - 1) < 1e-6 for n in norms.values())
    assert not any(url == "d3" for url, _ in found)


def test_words_are_counted_where_their_document_is(spark, tmp_path):
    rows = [(f"d{i}", " ".join(f"w{j % 7}" for j in range(i))) for i in range(60)]
    spark.createDataFrame(rows, "url string, cleaned string").repartition(6).write.parquet(str(tmp_path / "texts"))
    counts = terms.term_counts(spark.read.parquet(str(tmp_path / "texts")))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = {(r.url, r.token): r.tf for r in counts.collect()}
    assert found == {(u, w): t.split().count(w) for u, t in rows for w in set(t.split())}


@pytest.mark.parametrize("broadcast_bytes", [terms.BROADCAST_BYTES, 0])
def test_lookup_vectors_keeps_every_known_occurrence(spark, monkeypatch, broadcast_bytes):
    monkeypatch.setattr(terms, "BROADCAST_BYTES", broadcast_bytes)
    tokens = spark.createDataFrame([("d", 0, "red"), ("d", 1, "red"), ("d", 2, "x"), ("e", 0, "blue")], "url string, pos int, token string")
    wv = spark.createDataFrame(list(VECTORS.items()), "word string, vector array<double>")
    idf = spark.createDataFrame([("red", 1.5), ("x", 1.0), ("fish", 2.0)], "token string, idf double")
    found = terms.lookup_vectors(tokens, wv, idf, ["url", "pos"]).collect()
    assert sorted((r.url, r.pos, r.idf, tuple(r.vector)) for r in found) == [("d", 0, 1.5, (1.0, 0.0)), ("d", 1, 1.5, (1.0, 0.0))]


def test_lemmas_are_applied_before_stop_words(spark):
    df = spark.createDataFrame([("d", "Cats were running, cat"), ("e", "!")], "url string, content string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("running", "the")], "form string, lemma string")
    rows = dict(map(tuple, terms.preprocess_texts(df, lemmas=lemmas).collect()))
    assert rows == {"d": "cat cat", "e": X.STUB}


def test_extractive_summary(spark):
    df = spark.createDataFrame(
        [("d1", "red red. blue fish. fish. red fish. blue blue"), ("d2", " . the. "), ("d3", "red")],
        "url string, content string",
    )
    wv = spark.createDataFrame(list(VECTORS.items()), "word string, vector array<double>")
    vectorizer = terms.fit_vectorizer(df, word_vectors=wv)
    rows = dict(map(tuple, extractive_summary(df, vectorizer).collect()))
    assert rows["d2"] == "No summary" and rows["d3"] == "Red."
    # all sentences make the center, only the first four can be chosen
    parts = ["red red", "blue fish", "fish", "red fish", "blue blue"]
    sentences = spark.createDataFrame(list(enumerate(parts)), "url int, content string")
    vectors = {r.url: np.array(r.v) for r in vectorizer.transform(sentences).select("url", as_array(F.col("features")).alias("v")).collect()}
    center = np.mean(list(vectors.values()), axis=0)
    best = min(range(4), key=lambda i: np.linalg.norm(vectors[i] - center))
    assert rows["d1"] == parts[best].capitalize() + "."


def test_sentences_are_lemmatized_like_the_vocabulary(spark):
    df = spark.createDataFrame([("d", "reds reds. fishes. blues reds. fishes fishes")], "url string, content string")
    wv = spark.createDataFrame(list(VECTORS.items()), "word string, vector array<double>")
    lemmas = spark.createDataFrame([("reds", "red"), ("fishes", "fish"), ("blues", "blue")], "form string, lemma string")
    plain = spark.createDataFrame([("d", "red red. fish. blue red. fish fish")], "url string, content string")
    ours = extractive_summary(df, terms.fit_vectorizer(df, word_vectors=wv, lemmas=lemmas)).first().summary
    theirs = extractive_summary(plain, terms.fit_vectorizer(plain, word_vectors=wv)).first().summary
    assert [lemma for w in ours.strip(".").lower().split() for lemma in [w.removesuffix("es") if w == "fishes" else w.removesuffix("s")]] == theirs.strip(".").lower().split()


def test_pages_without_an_article(spark):
    html = [
        ("http://s.org/m", "<title>M</title><body><nav>menu</nav><main>It&#8217;s <b>main</b> &#x41;</main></body>"),
        ("http://s.org/p", "<body><p>One</p><footer><p>foot</p></footer><pre>no</pre><p class='x'>two &amp;#65; &#0;</p></body>"),
        ("http://s.org/n", "<body><div>none</div></body>"),
    ]
    pages = spark.createDataFrame(html, "url string, html string")
    found = {r.url[-1]: r.content for r in extract_articles(pages, F.lit("2024-01-01")).collect()}
    assert found == {"m": "It\u2019s main A", "p": "One two &#65; &#0;", "n": None}


def test_only_links_to_pages_are_candidates(spark):
    html = "<link rel='x' href='/style'><link href='/a.css'><a class='b' href='/read'>r</a><a href='/feed.xml'>f</a><a href='/pic.JPG?x=1'>p</a>"
    pages = spark.createDataFrame([("http://s.org/p", html)], "url string, html string")
    assert [r.url for r in discover_urls(pages).collect()] == ["http://s.org/read"]


def test_language(spark):
    labelled = spark.createDataFrame(
        [("en", "the cat and the dog and the house of the king"), ("de", "der hund und die katze und das haus")], "lang string, content string"
    )
    profiles = fit_language_profiles(labelled, ["de", "en"])
    df = spark.createDataFrame([("a", "the king and the cat"), ("b", "und der hund"), ("c", "1 2 3"), ("d", None)], "url string, content string")
    found = {r.url: r.language for r in detect_language(df, profiles, ["de", "en"]).collect()}
    assert found == {"a": "en", "b": "de"}
    assert [r.url for r in select_language(df, profiles, ["de", "en"]).collect()] == ["a"]


def test_language_workers_get_small_batches(spark):
    """A worker's memory follows the bytes of a batch, whatever the number and length of the texts."""
    from topicflow.operators.lang import BATCH_CHARACTERS, language_of
    from topicflow.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    labelled = spark.createDataFrame([("en", "the cat"), ("de", "die katze")], "lang string, content string")
    spark.conf.unset(key)
    profiles = fit_language_profiles(labelled, ["de", "en"])
    assert spark.conf.get(key) == f"{BATCH_BYTES}b"
    spark.conf.unset(key)
    language_of(profiles, ["de", "en"])
    assert spark.conf.get(key) == f"{BATCH_BYTES}b"

    def size(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.get_total_buffer_size()], pa.int64())], ["n"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("t"))  # 30 MB in one task
    sizes = [r.n for r in rows.mapInArrow(size, "n long").collect()]
    assert len(sizes) > 5 and max(sizes) < 3 * BATCH_BYTES
    assert BATCH_CHARACTERS * 8 <= BATCH_BYTES
