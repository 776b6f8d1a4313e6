"""Registry, the views bound to the given tables, and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import EXTRA_STOP_WORDS, STOP_WORDS, lead_summary
from ..functions.vectors import as_vector
from ..operators.terms import preprocess_texts
from ..session import materialize, spread_scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ALL_TIME = "2024-01-01 00:00:00"
LANGUAGES = ("de", "en", "es", "fr")
LEVELS = ["l0", "l1"]
VECTOR_SIZE = 4


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spread_scan(table(spark, sf, "pages").select("url", "html"), "url")


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """documents as articles; the parse time is derived from the id, as the table has none."""
    parsed = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 60)")
    rows = table(spark, sf, "documents").select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("title"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("published_at"),
        parsed.cast("string").alias("parse_datetime"),
    )
    return spread_scan(rows, "url")


def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels derived from the id: they check the operators apart from any model."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        (F.col("doc_id") % 5).cast("int").alias("l0"),
        (F.col("doc_id") % 3).cast("int").alias("l1"),
    )


def article_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).select("url", lead_summary(F.col("content")).alias("summary"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings with the label as a cluster label."""
    return table(spark, sf, "embeddings").select("vec_id", "label", as_vector(F.col("embedding")).alias("features"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess_texts(articles(spark, sf))


def staged_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts for queries that read them several times."""
    return materialize(cleaned(spark, sf), name="cleaned")


def hash_vector(word: str) -> F.Column:
    """A vector per word from the digits of its md5: word vectors that SQL can compute too."""
    digits = [f"(instr('0123456789abcdef', substr(md5({word}), {i}, 1)) - 8.5D) * 0.09371238761D" for i in range(1, VECTOR_SIZE + 1)]
    return F.expr(f"array({', '.join(digits)})")


def word_vectors(texts: DataFrame) -> DataFrame:
    """(word, vector) of the words that occur twice in cleaned texts."""
    words = texts.select(F.explode(F.split("cleaned", " ")).alias("word"))
    frequent = words.groupBy("word").count().where("count >= 2")
    return frequent.select("word", hash_vector("word").alias("vector"))


def as_sql_list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


ARTICLES = """articles AS (
    SELECT 'doc://' || doc_id AS url, source AS title, text AS content, CAST(NULL AS VARCHAR) AS published_at,
        strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS parse_datetime
    FROM documents)"""
TOPIC_LABELS = """topic_labels AS (
    SELECT 'doc://' || doc_id AS url, CAST(doc_id % 5 AS INTEGER) AS l0, CAST(doc_id % 3 AS INTEGER) AS l1
    FROM documents)"""
PATHS = """paths AS (
    SELECT url, 0 AS level, CAST(l0 AS VARCHAR) AS topic_path FROM topic_labels
    UNION ALL SELECT url, 1, l0 || '_' || l1 FROM topic_labels)"""


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lead_sql(x: str) -> str:
    return strip_sql(f"array_to_string(list_slice(string_split({x}, '.'), 1, 2), ' ')")


def first_sentences_sql(x: str, n: int = 3) -> str:
    marked = rf"regexp_replace({strip_sql(x)}, '([.!?]+[\"'')\]]*)\s+', '\1' || chr(1), 'g')"
    return f"array_to_string(list_slice(string_split({marked}, chr(1)), 1, {n}), ' ')"


SUMMARIES = f"summaries AS (SELECT 'doc://' || doc_id AS url, {lead_sql('text')} AS summary FROM documents)"


def clean_sql(x: str) -> str:
    letters = rf"regexp_replace(lower({x}), '[^A-Za-zА-Яа-я\s]+', ' ', 'g')"
    return rf"trim(regexp_replace({letters}, '\s+', ' ', 'g'))"


STOPS = f"stops AS (SELECT unnest([{as_sql_list(STOP_WORDS)}]) AS word)"
EXTRA_STOPS = as_sql_list(sorted(set(EXTRA_STOP_WORDS)))
# (url, pos, token) of the cleaned documents, the stub where nothing is left; positions before stop words
TOKENS = f"""{STOPS}, raw_tokens AS (
    SELECT url, unnest(words) AS token, generate_subscripts(words, 1) AS pos
    FROM (SELECT 'doc://' || doc_id AS url, string_split({clean_sql('text')}, ' ') AS words FROM documents)),
kept_tokens AS (SELECT * FROM raw_tokens WHERE length(token) > 0 AND token NOT IN (SELECT word FROM stops)),
tokens AS (
    SELECT url, CAST(row_number() OVER (PARTITION BY url ORDER BY pos) - 1 AS INTEGER) AS pos, token FROM kept_tokens
    UNION ALL
    SELECT 'doc://' || doc_id, 0, '$$$STUB$$$' FROM documents
    WHERE 'doc://' || doc_id NOT IN (SELECT url FROM kept_tokens))"""
TF = f"""{TOKENS}, tf AS (SELECT url, token, count(*) AS tf FROM tokens GROUP BY url, token),
idf AS (SELECT token, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
    FROM tf WHERE length(token) >= 2 AND token <> '$$$STUB$$$' GROUP BY token)"""
TFIDF = f"""{TF}, tfidf AS (
    SELECT url, token, tf, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY url)) AS w
    FROM tf JOIN idf USING (token))"""
_V = ", ".join(
    f"(instr('0123456789abcdef', substr(md5(token), {i}, 1)) - 8.5) * 0.09371238761 :: DOUBLE AS v{i}" for i in range(1, VECTOR_SIZE + 1)
)
WORD_VECTORS = f"wv AS (SELECT token, {_V} FROM tokens GROUP BY token HAVING count(*) >= 2)"
_SUMS = ", ".join(f"coalesce(sum(tf * w * v{i}) / sum(tf), 0) AS v{i}" for i in range(1, VECTOR_SIZE + 1))
_ZERO = ", ".join(f"coalesce(v{i}, 0.0) AS v{i}" for i in range(1, VECTOR_SIZE + 1))
DOC_VECTORS = f"""{TFIDF}, {WORD_VECTORS}, doc_sums AS (
    SELECT url, {_SUMS} FROM tfidf JOIN wv USING (token) GROUP BY url),
doc_vectors AS (SELECT d.url, {_ZERO} FROM (SELECT 'doc://' || doc_id AS url FROM documents) d LEFT JOIN doc_sums USING (url))"""
EMB = """emb AS (
    SELECT vec_id, label, unnest(embedding) :: DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"""
CENTROIDS = f"{EMB}, centers AS (SELECT label, dim, avg(x) AS x FROM emb GROUP BY label, dim)"
DISTANCES = f"""{CENTROIDS}, distances AS (
    SELECT a.label AS a, b.label AS b, 1 - sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS dist
    FROM centers a JOIN centers b USING (dim) WHERE a.label <> b.label GROUP BY a.label, b.label)"""
SIZES = "sizes AS (SELECT label, count(*) AS size FROM embeddings GROUP BY label)"


def bins_sql(name: str, source: str, column: str) -> str:
    """CTEs for quantile intervals of ``column``: edges, rounding precision, intervals."""
    points = ", ".join(str(i / 20) for i in range(21))
    r = (
        "CASE WHEN e = 0 THEN e ELSE round_even(e * pow(10, d), 0) / pow(10, d) END"
    )
    return f"""{name}_edges AS (
    SELECT DISTINCT e FROM (SELECT unnest(quantile_cont({column} :: DOUBLE, [{points}])) AS e FROM {source})),
{name}_digits AS (SELECT e, p, CASE WHEN abs(e) >= 1 THEN p
        WHEN e = 0 THEN p ELSE -floor(log10(abs(e))) - 1 + p END AS d
    FROM {name}_edges, (SELECT unnest(range(3, 20)) AS p)),
{name}_rounded AS (SELECT e, p, {r} AS r FROM {name}_digits),
{name}_precision AS (SELECT coalesce(min(p), 3) AS p FROM (
    SELECT p FROM {name}_rounded GROUP BY p HAVING count(DISTINCT r) = count(*))),
{name}_breaks AS (SELECT r, p, row_number() OVER (ORDER BY e) - 1 AS i
    FROM {name}_rounded JOIN {name}_precision USING (p)),
{name}_bins AS (SELECT CAST(lo.i AS INTEGER) AS bin,
        CASE WHEN lo.i = 0 THEN lo.r - pow(10, -lo.p) ELSE lo.r END AS "left", hi.r AS "right"
    FROM {name}_breaks lo JOIN {name}_breaks hi ON hi.i = lo.i + 1),
{name}_gap AS (SELECT max(ratio) AS ratio, arg_max("right", (ratio, -bin)) AS threshold FROM (
    SELECT bin, "right", CASE WHEN "left" = 0 THEN 'infinity' :: DOUBLE ELSE "right" / abs("left") END AS ratio
    FROM {name}_bins WHERE bin < (SELECT max(bin) FROM {name}_bins)))"""


def closure_sql(labels: str, pairs: str) -> str:
    """CTEs: smallest reachable label over pairs, numbered from 0."""
    return f"""reach(label, seen) AS (
    SELECT label, label FROM {labels}
    UNION
    SELECT e.a, r.seen FROM reach r JOIN (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs}) e ON e.b = r.label),
targets AS (SELECT label, min(seen) AS target FROM reach GROUP BY label),
mapping AS (SELECT label, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS new_label FROM targets)"""


def overlap_sql(labels: str, pairs: str) -> str:
    """CTEs: groups of the overlap rule on lists of labels, smallest label each, numbered from 0."""
    return f"""neighbours AS (SELECT a, list_sort(list_distinct(list(b) || [a])) AS s FROM {pairs} GROUP BY a),
unique_sets AS (SELECT s, min(a) AS a FROM neighbours GROUP BY s),
reduced(step, sets, sizes) AS (
    SELECT 1, list(s ORDER BY len(s) DESC, a), list_reverse_sort(list_distinct(list(len(s)))) FROM unique_sets
    UNION ALL
    SELECT step + 1, list_transform(sets, lambda x: CASE WHEN len(x) = sizes[step]
        THEN list_filter(x, lambda l: NOT list_contains(gone, l)) ELSE x END), sizes
    FROM (SELECT *, flatten(list_filter(sets, lambda y: len(y) > 1 AND len(y) < sizes[step] AND list_contains(sizes, len(y))
            AND len(list_filter(sets, lambda z: len(z) = sizes[step] AND list_has_all(z, y))) > 0)) AS gone
        FROM reduced WHERE step < len(sizes))),
last_sets AS (SELECT unnest(sets) AS s, generate_subscripts(sets, 1) AS place
    FROM (SELECT sets FROM reduced ORDER BY step DESC LIMIT 1)),
ranked_sets AS (SELECT s, row_number() OVER (ORDER BY min(place)) AS i FROM last_sets WHERE len(s) > 1 GROUP BY s),
growth(i, upto, g) AS (
    SELECT i, i, s FROM ranked_sets
    UNION ALL
    SELECT w.i, n.i, CASE WHEN list_has_any(w.g, n.s) THEN list_distinct(w.g || n.s) ELSE w.g END
    FROM growth w JOIN ranked_sets n ON n.i = w.upto + 1),
grown_sets AS (SELECT i, g FROM growth WHERE upto = (SELECT max(i) FROM ranked_sets)),
kept_sets(i, taken, kept) AS (
    SELECT 1, g, [g] FROM grown_sets WHERE i = 1
    UNION ALL
    SELECT k.i + 1, CASE WHEN list_has_any(taken, g) THEN taken ELSE taken || g END,
        CASE WHEN list_has_any(taken, g) THEN kept ELSE kept || [g] END
    FROM kept_sets k JOIN grown_sets n ON n.i = k.i + 1),
final_sets AS (SELECT unnest(kept) AS g FROM (SELECT kept FROM kept_sets ORDER BY i DESC LIMIT 1)),
members AS (SELECT unnest(g) AS label, list_min(g) AS target FROM final_sets),
targets AS (SELECT DISTINCT l.label, coalesce(m.target, l.label) AS target FROM {labels} l LEFT JOIN members m ON m.label = l.label),
mapping AS (SELECT label, CAST(dense_rank() OVER (ORDER BY target) - 1 AS INTEGER) AS new_label FROM targets)"""
