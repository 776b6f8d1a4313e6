import pytest

from topicflow.operators import sentence_ends
from topicflow.operators.lemmas import lemma_dictionary
from topicflow.operators.sentence_ends import abbreviations, learned_sentences, stop_counts
from topicflow.operators.terms import lemmatize

STORY = [
    "Dr. Smith met Dr. Jones on the hill. They ate bread.",
    "The doctor slept. Dr. Brown, e.g. a friend, came back. It rained on the hill, and they ate.",
    "He said that Dr. Green left. \"They slept.\" We met (Dr. White) there, e.g. on a hill.",
    "All of it was bread. The rain on it was wet. They came to eat bread on the hill and came back.",
    None,
    "",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(STORY)), "url int, content string")


def test_abbreviations_are_learned(texts):
    found = {r.word: (r.dotted, r.plain) for r in abbreviations(texts).collect()}
    assert found == {"dr": (5, 0), "e.g": (2, 0)}


def test_no_full_stop_no_abbreviation(spark, texts):
    assert abbreviations(spark.createDataFrame([("no stop here",)], "content string")).isEmpty()
    assert abbreviations(texts.limit(0)).isEmpty()
    assert abbreviations(spark.createDataFrame([("etc.",)], "content string")).count() <= 1


def test_abbreviations_end_no_sentence(texts):
    found = {r.url: r.sentences for r in learned_sentences(texts, abbreviations(texts)).collect()}
    assert found[0] == ["Dr. Smith met Dr. Jones on the hill.", "They ate bread."]
    assert found[1][1] == "Dr. Brown, e.g. a friend, came back."
    assert found[2] == ["He said that Dr. Green left.", '"They slept."', "We met (Dr. White) there, e.g. on a hill."]
    assert found[4] is None and found[5] == [""]


def test_repeated_and_null_keys_keep_their_sentences(spark):
    rows = spark.createDataFrame([(1, "A dr. B. C"), (1, "D. E"), (None, "dr. F. G")], "url int, content string")
    known = spark.createDataFrame([("dr",), ("dr",)], "word string")
    found = sorted(r.sentences for r in learned_sentences(rows, known).collect())
    assert found == [["A dr. B.", "C"], ["D.", "E"], ["dr. F.", "G"]]


def test_lemmas_from_rules(spark):
    words = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    forms = words("form", "cities", "boxes", "glass", "wolves", "women", "mice", "news", "axes", "dogs", "s", "", None)
    vocabulary = words("word", "city", "box", "glass", "wolf", "woman", "news", "axe", "ax", "dog", "dogs", "dog", None)
    exceptions = spark.createDataFrame([("mice", "mouse"), ("mice", "mousse"), ("unused", "x")], "form string, lemma string")
    found = {r.form: r.lemma for r in lemma_dictionary(forms, vocabulary, exceptions).collect()}
    assert found == {
        "cities": "city", "boxes": "box", "wolves": "wolf", "women": "woman", "mice": "mouse", "axes": "ax", "dogs": "dog",
    }
    tokens = spark.createDataFrame([("u", 0, "dogs"), ("u", 1, "glass")], "url string, pos int, token string")
    lemmas = lemma_dictionary(forms, vocabulary, exceptions)
    assert sorted(r.token for r in lemmatize(tokens, lemmas).collect()) == ["dog", "glass"]
    assert lemma_dictionary(forms.limit(0), vocabulary).isEmpty()


def test_counts_of_odd_tokens(spark):
    texts = spark.createDataFrame([("Mr. (e.g.) a.b.. don't x-y \"Q.\", .z z.\u0085",), ("mr 3rd. Été. ((é.t.é.\")\n",), (None,)], "content string")
    found = {r.word: (r.dotted, r.plain) for r in stop_counts(texts).collect()}
    assert found == {"mr": (1, 1), "e.g": (1, 0), "q": (1, 0), "z": (1, 0), "été": (1, 0), "é.t.é": (1, 0)}


def test_few_and_many_abbreviations_give_the_same(texts, monkeypatch):
    known = abbreviations(texts)
    few = learned_sentences(texts, known)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # the texts stay where they lie
    monkeypatch.setattr(sentence_ends, "FEW", 1)
    many = learned_sentences(texts, known)
    assert "Join" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
