"""Text expressions, terms and document vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import as_array, l2_normalize
from ..operators import lemmas, terms
from ..operators import sentence_ends as E
from ..operators.lemmas import NOUN_RULES
from ..operators.word_vectors import word_associations
from ..session import materialize
from .base import (
    ARTICLES,
    DOC_VECTORS,
    EXTRA_STOPS,
    SUMMARIES,
    TF,
    TFIDF,
    TOKENS,
    WORD_VECTORS,
    articles,
    clean_sql,
    cleaned,
    first_sentences_sql,
    hash_vector,
    lead_sql,
    query,
    strip_sql,
    table,
    staged_texts,
    word_vectors,
)

DOC = "'doc://' || doc_id AS url"


@query("clean_text", f"SELECT {DOC}, {clean_sql('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return articles(spark, sf).select("url", X.clean_text(F.col("content")).alias("cleaned"))


@query(
    "remove_stopwords",
    f"""WITH words AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
        SELECT item_id, string_split({clean_sql('text')}, ' ') AS w FROM benchmark))
    SELECT item_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words
    WHERE word NOT IN ({EXTRA_STOPS}) AND word <> '' GROUP BY item_id""",
)
def remove_stopwords(spark, sf):
    tokens = X.tokenize(X.clean_text(F.col("text")))
    return table(spark, sf, "benchmark").select(
        "item_id", F.array_join(X.remove_stopwords(tokens, X.EXTRA_STOP_WORDS), " ").alias("kept")
    )


@query(
    "preprocess_texts",
    f"WITH {TOKENS} SELECT url, string_agg(token, ' ' ORDER BY pos) AS cleaned FROM tokens GROUP BY url",
)
def preprocess_texts(spark, sf):
    return cleaned(spark, sf)


@query(
    "stub_if_empty",
    f"""SELECT line, CASE WHEN c = '' THEN '$$$STUB$$$' ELSE c END AS cleaned FROM (
        SELECT line, {clean_sql('line')} AS c FROM (
            SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents))""",
)
def stub_if_empty(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select("line", X.stub_if_empty(X.clean_text(F.col("line"))).alias("cleaned"))


@query(
    "tokenize",
    f"""SELECT * FROM (SELECT {DOC}, unnest(words) AS token FROM (
        SELECT doc_id, string_split({clean_sql('text')}, ' ') AS words FROM documents)) WHERE length(token) >= 2""",
)
def tokenize(spark, sf):
    return articles(spark, sf).select("url", F.explode(X.tokenize(X.clean_text(F.col("content")), 2)).alias("token"))


@query(
    "content_hash",
    """SELECT 'doc://' || doc_id AS url, sha256(coalesce(CASE WHEN quality = 0 THEN NULL ELSE text END, 'None')) AS hash
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def content_hash(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    content = F.when(F.coalesce("quality", F.lit(1)) != 0, F.col("text"))
    return rows.select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), X.content_hash(content).alias("hash")
    )


@query("normalize_ws", r"SELECT 'doc://' || doc_id AS url, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_ws(spark, sf):
    return articles(spark, sf).select("url", X.normalize_ws(F.col("content")).alias("text"))


@query(
    "sentences",
    f"SELECT {DOC}, unnest(p) AS sentence, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos "
    "FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)",
)
def sentences(spark, sf):
    return articles(spark, sf).select("url", F.posexplode(X.sentences(F.col("content"))).alias("pos", "sentence"))


@query("lead_summary", f"WITH {SUMMARIES} SELECT url, summary FROM summaries")
def lead_summary(spark, sf):
    return articles(spark, sf).select("url", X.lead_summary(F.col("content")).alias("summary"))


@query("capitalize_sentence", "SELECT item_id, upper(left(text, 1)) || substr(text, 2) || '.' AS text FROM benchmark")
def capitalize_sentence(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.capitalize_sentence(F.col("text")).alias("text"))


@query("wrap_summary", f"WITH {SUMMARIES} SELECT url, replace(summary, '.', '.' || chr(10)) AS summary FROM summaries")
def wrap_summary(spark, sf):
    return articles(spark, sf).select("url", X.wrap_summary(X.lead_summary(F.col("content"))).alias("summary"))


@query(
    "first_sentences",
    f"SELECT {DOC}, {first_sentences_sql('text')} AS lead FROM documents",
)
def first_sentences(spark, sf):
    return articles(spark, sf).select("url", X.first_sentences(F.col("content")).alias("lead"))


# words with their counts before a full stop and elsewhere, scored by log-likelihood ratio
_OPENING, _WORD, _CLOSING = "[\"''(\\[]*", r"\p{L}(?:[\p{L}.]*\p{L})?", "[,;:!?\"'')\\]]*"
ABBREVIATIONS = rf"""stop_tokens AS (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS token FROM documents),
stop_words AS (SELECT regexp_extract(token, '^{_OPENING}({_WORD})[.]?{_CLOSING}$', 1) AS word,
    regexp_matches(token, '^{_OPENING}{_WORD}[.]{_CLOSING}$') AS dot FROM stop_tokens),
stop_counts AS (SELECT word, count(*) FILTER (dot) AS dotted, count(*) FILTER (NOT dot) AS plain
    FROM stop_words WHERE word <> '' GROUP BY word),
stop_total AS (SELECT sum(dotted) AS d, sum(dotted + plain) AS n FROM stop_counts),
stop_scores AS (SELECT word, dotted, plain, length(replace(word, '.', '')) AS letters,
    -2 * (dotted * ln(d / n) + CASE WHEN plain > 0 THEN plain * ln(1 - d / n) ELSE 0 END
        - dotted * ln(0.99) - plain * ln(0.01)) AS ratio FROM stop_counts, stop_total WHERE dotted > 0),
abbreviations AS (SELECT * FROM (SELECT word, dotted, plain,
    ratio * exp(-letters) * (length(word) - letters + 1) * pow(letters, -plain) AS score FROM stop_scores) WHERE score >= 0.3)"""


@query("abbreviations", f"WITH {ABBREVIATIONS} SELECT word, dotted, plain, round(score, 6) AS score FROM abbreviations")
def abbreviations(spark, sf):
    return E.abbreviations(articles(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "learned_sentences",
    rf"""WITH {ABBREVIATIONS}, marked AS (
        SELECT doc_id, string_split(regexp_replace({strip_sql('text')}, '([.!?]+["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)) AS p
        FROM documents),
    pieces AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM marked),
    ended AS (SELECT doc_id, piece, i, regexp_extract(lower(piece), '(?:^|\s){_OPENING}({_WORD})[.]$', 1)
        IN (SELECT word FROM abbreviations) AS inside FROM pieces),
    numbered AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ended)
    SELECT {DOC}, CAST(coalesce(before, 0) AS INTEGER) AS pos, string_agg(piece, ' ' ORDER BY i) AS sentence
    FROM numbered GROUP BY doc_id, coalesce(before, 0)""",
)
def learned_sentences(spark, sf):
    rows = articles(spark, sf)
    known = materialize(E.abbreviations(rows).select("word"), name="abbreviations")
    # as an expression: before a plain column Spark filters by its size, and cuts the texts again for that
    same = F.transform("sentences", lambda sentence: sentence)
    return E.learned_sentences(rows, known).select("url", F.posexplode(same).alias("pos", "sentence"))


def _fold_sql(x: str) -> str:
    mapping = X.folding_table()
    singles = {k: v for k, v in mapping.items() if len(v) == 1}
    x = f"translate({x}, '{''.join(singles)}', '{''.join(singles.values())}')"
    for source, target in mapping.items():
        if len(target) != 1:
            x = f"replace({x}, '{source}', '{target}')"
    return x


@query("fold_characters", f"SELECT {DOC}, {_fold_sql('text')} AS folded FROM documents")
def fold_characters(spark, sf):
    return articles(spark, sf).select("url", X.fold_characters(F.col("content")).alias("folded"))


@query("format_time", f"WITH {ARTICLES} SELECT url, parse_datetime AS time FROM articles")
def format_time(spark, sf):
    return articles(spark, sf).select("url", X.format_time(F.col("parse_datetime").cast("timestamp")).alias("time"))


@query(
    "l2_normalize",
    """SELECT vec_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 6) AS x FROM (
        SELECT vec_id, unnest(embedding) :: DOUBLE AS x, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim
        FROM embeddings)""",
)
def l2_normalized(spark, sf):
    unit = l2_normalize(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("dim", "x"))
    return rows.select("vec_id", "dim", F.round("x", 6).alias("x"))


PLURALS = "lemmas AS (SELECT DISTINCT token AS form, substr(token, 1, length(token) - 1) AS lemma FROM {0} WHERE length(token) > 3 AND suffix(token, 's'))"


def plural_lemmas(spark, sf):
    """A dictionary made of the words that end in s."""
    words = articles(spark, sf).select(F.explode(X.tokenize(X.clean_text(F.col("content")))).alias("form")).distinct()
    plural = words.where("length(form) > 3 AND endswith(form, 's')")
    return plural.select("form", F.expr("substr(form, 1, length(form) - 1)").alias("lemma"))


@query(
    "lemmatize",
    f"""WITH raw_tokens AS (SELECT {DOC}, unnest(w) AS token, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos FROM (
        SELECT doc_id, string_split({clean_sql('text')}, ' ') AS w FROM documents)),
    words AS (SELECT * FROM raw_tokens WHERE token <> ''), {PLURALS.format('words')}
    SELECT url, pos, coalesce(lemma, token) AS token FROM words LEFT JOIN lemmas ON token = form""",
)
def lemmatize(spark, sf):
    rows = articles(spark, sf).select("url", X.tokenize(X.clean_text(F.col("content"))).alias("t"))
    tokens = terms.explode_tokens(rows, "url", F.col("t"))
    return terms.lemmatize(tokens, plural_lemmas(spark, sf), ("url", "pos"))


@query(
    "lemma_dictionary",
    f"""WITH forms AS (SELECT DISTINCT form FROM (
        SELECT unnest(string_split({clean_sql('text')}, ' ')) AS form FROM documents) WHERE form <> ''),
    rules AS (SELECT * FROM (VALUES (0, '', ''), {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(NOUN_RULES, 1))}) r(rule, ending, stem)),
    candidates AS (SELECT f.form, rule, left(f.form, length(f.form) - length(ending)) || stem AS word
        FROM forms f JOIN rules ON suffix(f.form, ending)),
    best AS (SELECT c.form, arg_min(word, (length(word), rule)) AS lemma
        FROM candidates c JOIN forms v ON v.form = c.word GROUP BY c.form)
    SELECT form, lemma FROM best WHERE lemma <> form""",
)
def lemma_dictionary(spark, sf):
    words = articles(spark, sf).select(F.explode(X.tokenize(X.clean_text(F.col("content")))).alias("form"))
    words = materialize(words.distinct(), name="words")
    return lemmas.lemma_dictionary(words, words.withColumnRenamed("form", "word"))


@query("term_counts", f"WITH {TF} SELECT url, token, tf FROM tf")
def term_counts(spark, sf):
    return terms.term_counts(cleaned(spark, sf))


@query("term_doc_freq", f"WITH {TF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def term_doc_freq(spark, sf):
    texts = cleaned(spark, sf)
    return terms.inverse_doc_freq(terms.term_counts(texts), texts).select("token", "df", F.round("idf", 6).alias("idf"))


@query("tfidf", f"WITH {TFIDF} SELECT url, token, tf, round(w, 6) AS w FROM tfidf")
def tfidf(spark, sf):
    texts = staged_texts(spark, sf)
    tf = terms.term_counts(texts)
    idf = materialize(terms.inverse_doc_freq(tf, texts), name="idf")
    return terms.tfidf(tf, idf).withColumn("w", F.round("w", 6))


@query(
    "lookup_vectors",
    f"""WITH {TF}, {WORD_VECTORS}
    SELECT url, pos, token, round(idf, 6) AS idf, v1, v2, v3, v4 FROM tokens JOIN wv USING (token) JOIN idf USING (token)""",
)
def lookup_vectors(spark, sf):
    texts = staged_texts(spark, sf)
    tokens = terms.explode_tokens(texts, "url", F.split("cleaned", " "))
    idf = terms.inverse_doc_freq(terms.term_counts(texts), texts)
    found = terms.lookup_vectors(tokens, word_vectors(texts), idf, ["url", "pos"])
    return found.select(
        "url", "pos", "token", F.round("idf", 6).alias("idf"), *(F.col("vector")[i].alias(f"v{i + 1}") for i in range(4))
    )


def vector_columns(column: F.Column) -> list:
    return [F.round(column[i], 6).alias(f"v{i + 1}") for i in range(4)]


def hash_vectorizer(texts) -> terms.TextVectorizer:
    return terms.fit_cleaned(texts, word_vectors=materialize(word_vectors(texts), name="vectors"))


@query(
    "doc_vectors",
    f"WITH {DOC_VECTORS} SELECT url, round(v1, 6) AS v1, round(v2, 6) AS v2, round(v3, 6) AS v3, round(v4, 6) AS v4 FROM doc_vectors",
)
def doc_vectors(spark, sf):
    texts = staged_texts(spark, sf)
    vectors = hash_vectorizer(texts).transform_cleaned(texts)
    return vectors.select("url", as_array(F.col("features")).alias("a")).select("url", *vector_columns(F.col("a")))


_PLAIN = ", ".join(f"round(coalesce(avg(v{i}), 0), 6) AS v{i}" for i in range(1, 5))


@query(
    "doc_vectors_plain",
    f"WITH {TOKENS}, {WORD_VECTORS} SELECT url, {_PLAIN} FROM tokens LEFT JOIN wv USING (token) GROUP BY url",
)
def doc_vectors_plain(spark, sf):
    texts = staged_texts(spark, sf)
    vectorizer = hash_vectorizer(texts)
    vectorizer.use_tfidf = False
    vectors = vectorizer.transform_cleaned(texts)
    return vectors.select("url", as_array(F.col("features")).alias("a")).select("url", *vector_columns(F.col("a")))


_POOLED = ", ".join(f"avg(v{i}) AS v{i}" for i in range(1, 5))
_UNIT = ", ".join(f"round(v{i} / sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4), 6) AS v{i}" for i in range(1, 5))


@query(
    "mean_pool",
    f"""WITH {TOKENS}, {WORD_VECTORS.replace(' GROUP BY token HAVING count(*) >= 2', ' GROUP BY token')},
    pooled AS (SELECT url, {_POOLED} FROM tokens JOIN wv USING (token) WHERE length(token) >= 3 GROUP BY url)
    SELECT url, {_UNIT} FROM pooled""",
)
def mean_pool(spark, sf):
    tokens = terms.explode_tokens(cleaned(spark, sf), "url", F.split("cleaned", " "))
    vectors = tokens.withColumn("vector", hash_vector("token"))
    pooled = terms.mean_pool(vectors, "url", "vector", F.length("token") >= 3)
    return pooled.select("url", *vector_columns(F.col("vector")))


ASSOCIATIONS = f"""WITH {TOKENS},
frequent AS (SELECT token FROM tokens GROUP BY token HAVING count(*) >= 2),
near AS (
    SELECT least(a.token, b.token) AS word, greatest(a.token, b.token) AS other,
        CAST(sum((6 - d) * CASE WHEN a.token = b.token THEN 2 ELSE 1 END) AS BIGINT) AS n
    FROM (SELECT *, unnest(range(1, 6)) AS d FROM tokens) a JOIN tokens b ON b.url = a.url AND b.pos = a.pos + a.d
    GROUP BY least(a.token, b.token), greatest(a.token, b.token)),
degrees AS (
    SELECT token, sum(n) AS degree FROM (
        SELECT word AS token, n FROM near UNION ALL SELECT other, n FROM near WHERE word <> other) GROUP BY token),
weighed AS (
    SELECT word, other, n, ln(n * (SELECT sum(degree) FROM degrees) / (a.degree * b.degree)) AS pmi
    FROM near JOIN degrees a ON a.token = word JOIN degrees b ON b.token = other
    WHERE word IN (SELECT token FROM frequent) AND other IN (SELECT token FROM frequent))
SELECT word, other, n, round(pmi, 6) AS pmi FROM weighed WHERE pmi > 0"""


@query("word_associations", ASSOCIATIONS)
def associations(spark, sf):
    texts = staged_texts(spark, sf)
    return word_associations(texts).withColumn("pmi", F.round("pmi", 6))


@query("word2vec")
def word2vec(spark, sf):
    texts = staged_texts(spark, sf)
    return terms.fit_word_vectors(texts)
