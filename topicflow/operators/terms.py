"""Terms, TF-IDF and document vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import (
    STOP_WORDS,
    STUB,
    clean_text,
    preprocess,
    remove_stopwords,
    stub_if_empty,
    tokenize,
)
from ..functions.vectors import as_array, as_vector, l2_normalize, mean_vector
from ..session import discard, materialize
from .placement import lookup_join, skew_join
from .word_vectors import fit_word_vectors

BROADCAST_BYTES = 256 << 20
HEAD_BYTES = 128 << 20  # of the most frequent words, which every Python worker holds
CHUNK_NUMBERS = 1 << 21
DICTIONARY_ROWS = 500_000


def explode_tokens(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, pos, token) with 0-based positions."""
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))


def lemmatize(tokens: DataFrame, lemmas: DataFrame, spread: Iterable[str] = ("pos",)) -> DataFrame:
    """Replace tokens found in the dictionary (form, lemma); the others stay."""
    lemmas = lemmas.select(F.col("form").alias("token"), "lemma")
    joined = lookup_join(tokens, lemmas, "token", list(spread), "left", DICTIONARY_ROWS)
    return joined.withColumn("token", F.coalesce("lemma", "token")).select(tokens.columns)


def preprocess_texts(
    df: DataFrame,
    key: str = "url",
    text: str = "content",
    lemmas: DataFrame | None = None,
    words: Iterable[str] = STOP_WORDS,
) -> DataFrame:
    """(key, cleaned): cleaned, lemmatized text without stop words, or the stub.

    Without a dictionary this is one expression per row and shuffles nothing.
    """
    if lemmas is None:
        return df.select(key, preprocess(F.col(text), words).alias("cleaned"))
    tokens = explode_tokens(df.select(key, tokenize(clean_text(F.col(text))).alias("t")), key, F.col("t"))
    lemmatized = lemmatize(tokens, lemmas, (key, "pos"))
    # one document's words meet again: bounded by the length of a text
    ordered = lemmatized.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    kept = ordered.select(key, remove_stopwords(F.transform("t", lambda s: s["token"]), words).alias("t"))
    return (
        df.select(key)
        .join(kept, key, "left")
        .select(key, stub_if_empty(F.coalesce(F.array_join("t", " "), F.lit(""))).alias("cleaned"))
    )


def first_places(words: Column) -> Column:
    """Where each distinct word of a sorted array begins."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.filter(places, lambda i: (i < F.size(words)) & ((i == 0) | (F.get(words, i) != F.get(words, i - 1))))


def term_counts(cleaned: DataFrame, key: str = "url", min_length: int = 1) -> DataFrame:
    """(key, token, tf).

    A document is one row, so its words are counted inside the row, by sorting them: nothing
    is shuffled, and what later operators move are distinct words, not occurrences.
    """
    words = cleaned.select(key, F.sort_array(tokenize(F.col("cleaned"), min_length)).alias("_words"))
    placed = words.select(key, "_words", first_places(F.col("_words")).alias("_starts"))
    # a word's count is the distance to the next word's first place
    stop = lambda i: F.coalesce(F.get("_starts", i + 1), F.size("_words"))
    pairs = F.transform(
        "_starts", lambda at, i: F.struct(F.get("_words", at).alias("token"), (stop(i) - at).cast("long").alias("tf"))
    )
    return placed.select(key, F.inline(pairs))


def term_doc_freq(tf: DataFrame) -> DataFrame:
    return tf.groupBy("token").agg(F.count("*").alias("df"))


def in_vocabulary(token: str = "token") -> Column:
    """The TF-IDF vocabulary has words of two letters or more and not the stub."""
    return (F.length(token) >= 2) & (F.col(token) != STUB)


def inverse_doc_freq(tf: DataFrame, documents: DataFrame) -> DataFrame:
    """(token, df, idf) with ``idf = ln((1 + N) / (1 + df)) + 1``."""
    n = documents.agg(F.count("*")).scalar()
    return term_doc_freq(tf.where(in_vocabulary())).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)


def tfidf(tf: DataFrame, idf: DataFrame, key: str = "url") -> DataFrame:
    """(key, token, tf, w): tf * idf, scaled to unit length per document.

    Spark broadcasts ``idf`` when it is small; beyond that, it may split the rows of a word that
    very many documents share.  A document's words meet once, for its norm.
    """
    weighted = tf.join(idf.select("token", "idf"), "token").withColumn("raw", F.col("tf") * F.col("idf"))
    # one document's distinct words: bounded by the length of a text
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "token", "tf", (F.col("raw") / norm).alias("w"))


def row_bytes(size: int) -> int:
    """Memory of one vocabulary row."""
    return 8 * size + 64


def lookup_vectors(tokens: DataFrame, word_vectors: DataFrame, idf: DataFrame, spread: Iterable[str]) -> DataFrame:
    """Tokens known to both vocabularies with vector and idf; each occurrence counts.

    The vocabulary is staged, measured, and broadcast or joined with salts.
    """
    vocabulary = materialize(
        word_vectors.withColumnRenamed("word", "token").join(idf.select("token", "idf"), "token"), name="vocabulary"
    )
    size, words = vocabulary.agg(F.max(F.size("vector")), F.count("*")).first()
    if words * row_bytes(size or 0) <= BROADCAST_BYTES:
        return tokens.join(F.broadcast(vocabulary), "token")
    return skew_join(tokens, vocabulary, "token", list(spread))


@dataclass
class TextVectorizer:
    """A fitted vocabulary (token, vector, idf, df); the last two are null outside the TF-IDF vocabulary."""

    vocabulary: DataFrame
    size: int
    words: int
    lemmas: DataFrame | None = None
    use_tfidf: bool = True
    _type: str | None = field(default=None, init=False, repr=False)
    _words: Broadcast | None = field(default=None, init=False, repr=False)

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        spark = self.vocabulary.sparkSession
        options = [(self.size, self.words, self.use_tfidf, self.lemmas is not None)]
        schema = "size int, words long, use_tfidf boolean, lemmas boolean"
        spark.createDataFrame(options, schema).write.mode("overwrite").parquet(f"{path}/options")
        if self.lemmas is not None:
            self.lemmas.write.mode("overwrite").parquet(f"{path}/lemmas")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextVectorizer:
        options = spark.read.parquet(f"{path}/options").first()
        lemmas = spark.read.parquet(f"{path}/lemmas") if options.lemmas else None
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return cls(vocabulary, options["size"], options.words, lemmas, options.use_tfidf)

    @property
    def word_vectors(self) -> DataFrame:
        return self.vocabulary.where("vector IS NOT NULL").select(F.col("token").alias("word"), "vector")

    def transform(self, df: DataFrame, key: str = "url", text: str = "content") -> DataFrame:
        return self.transform_cleaned(preprocess_texts(df, key, text, self.lemmas), key)

    def transform_cleaned(self, cleaned: DataFrame, key: str = "url") -> DataFrame:
        """(key, features): mean over the known occurrences of weight times word vector.

        With weight ``tf * idf / norm`` the norm is one number per document, so one
        aggregation gives the weighted vector sum, the norm and the number of occurrences.
        A document without a known word gets the zero vector.

        A document is one row.  The most frequent words of the vocabulary, as many as ``HEAD_BYTES``
        hold, are broadcast, and each document adds them up where it lies.  Only its other words, rare
        ones, meet the rest of the vocabulary by a join and come back as one vector each.
        """
        head = self._head()
        words = F.transform(tokenize(F.col("cleaned")), lambda w: F.xxhash64(w))
        rows = cleaned.where("cleaned IS NOT NULL").select(key, words.alias("words"))
        schema = T.StructType([rows.schema[key]]).add("word", "long").add("tf", "long")
        schema = schema.add("sum", T.ArrayType(T.DoubleType())).add("used", "long").add("square", "double")
        rare = self.words > len(head.value[0])
        parts = rows.mapInArrow(_head_sums(head, self.size, self.use_tfidf, rare), schema)
        if rare:
            parts = materialize(parts, name="parts")
            tail = self._hashed().join(self._head_keys(), "word", "left_anti")
            known = parts.where("word IS NOT NULL").join(tail, "word")
        none = [F.lit(None).cast("double").alias("idf"), F.lit(None).cast(self._vector_type()).alias("vector")]
        whole = parts.where("word IS NULL").select(*schema.names, *none)
        if rare:
            whole = whole.unionByName(known.select(*schema.names, "idf", "vector"))
        # the rows of a key lie together: its head, its rare words in order
        placed = whole.repartition(key).sortWithinPartitions(key, "word", "used", "square")
        out = T.StructType([rows.schema[key]]).add("features", T.ArrayType(T.DoubleType()))
        return placed.mapInArrow(_means(self.size, self.use_tfidf), out).select(key, as_vector(F.col("features")).alias("features"))

    def _vector_type(self) -> str:
        """Vectors of float numbers travel as such, which loses nothing."""
        if self._type is None:
            exact = F.forall("vector", lambda x: x == x.cast("float").cast("double"))
            self._type = "array<float>" if self.vocabulary.agg(F.bool_and(exact)).first()[0] else "array<double>"
        return self._type

    def _hashed(self) -> DataFrame:
        return self.vocabulary.select(F.xxhash64("token").alias("word"), "idf", F.col("vector").cast(self._vector_type()).alias("vector"))

    def _head(self) -> Broadcast:
        """Keys in order, idf (NaN where there is none), which words have a vector, and the vectors."""
        if self._words is None:
            number = 4 if self._vector_type() == "array<float>" else 8
            most = min(HEAD_BYTES, BROADCAST_BYTES) // (number * self.size + 24)
            order = [F.coalesce("df", F.lit(0)).desc(), F.col("token")]
            frequent = self.vocabulary.orderBy(*order).limit(most) if most < self.words else self.vocabulary
            table = frequent.select(F.xxhash64("token").alias("word"), "idf", F.col("vector").cast(self._type).alias("vector"))
            table = table.toArrow().combine_chunks()  # HEAD_BYTES at most
            order = np.argsort(table.column("word").to_numpy(), kind="stable")
            table = table.take(order)
            given = table.column("vector").is_valid().to_numpy()
            vectors = np.zeros((len(order), self.size), np.float32 if number == 4 else np.float64)
            vectors[given] = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.size)
            idf = table.column("idf").to_numpy().astype(np.float64)
            keys = table.column("word").to_numpy().astype(np.int64)
            self._words = self.vocabulary.sparkSession.sparkContext.broadcast((keys, idf, given, vectors))
        return self._words

    def _head_keys(self) -> DataFrame:
        keys = pa.table({"word": pa.array(self._head().value[0])})
        return self.vocabulary.sparkSession.createDataFrame(keys, "word long")


def _added(total: np.ndarray, rows: np.ndarray, vectors: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """Adds ``weight`` times the vectors ``at`` to the ``rows`` of ``total``; equal rows lie together."""
    step = max(1, CHUNK_NUMBERS // (8 * max(1, total.shape[1])))
    for begin in range(0, len(rows), step):
        cut = slice(begin, begin + step)
        first = np.flatnonzero(np.diff(rows[cut], prepend=-1))
        total[rows[cut][first]] += np.add.reduceat(vectors[at[cut]] * weight[cut, None], first, axis=0)


def _sum_lists(total: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))


def _head_sums(head: Broadcast, size: int, use_tfidf: bool, rare: bool):
    """(key, words) to one row per document with the sums of its frequent words, and one row (word, tf)
    for each of its other distinct words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, idf, given, vectors = head.value
        names = ["word", "tf", "sum", "used", "square"]
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()
            begin = 0
            while begin < len(lists):
                stop = int(np.searchsorted(bounds, bounds[begin] + CHUNK_NUMBERS // 8, "right")) - 1
                stop = max(begin + 1, min(stop, begin + CHUNK_NUMBERS // size))
                docs = stop - begin
                words = values[bounds[begin] : bounds[stop]]
                doc = np.repeat(np.arange(docs), np.diff(bounds[begin : stop + 1]))
                order = np.lexsort((words, doc))
                words, doc = words[order], doc[order]
                first = np.flatnonzero((np.diff(words, prepend=0) != 0) | (np.diff(doc, prepend=-1) != 0))
                tf = np.diff(first, append=len(words))
                words, doc = words[first], doc[first]
                at = np.minimum(np.searchsorted(keys, words), max(len(keys) - 1, 0))
                known = keys[at] == words if len(keys) else np.zeros(len(words), bool)
                own, times, row = at[known], tf[known].astype(np.float64), doc[known]
                usable = given[own] & ~np.isnan(idf[own]) if use_tfidf else given[own]
                weight = times * times * idf[own] if use_tfidf else times
                total = np.zeros((docs, size))
                _added(total, row[usable], vectors, own[usable], weight[usable])
                used = np.bincount(row[usable], times[usable], docs).astype(np.int64)
                square = np.bincount(row, np.nan_to_num(times * idf[own]) ** 2, docs).astype(np.float64)
                nulls = pa.nulls(docs, pa.int64())
                columns = [batch.column(0).slice(begin, docs), nulls, nulls, _sum_lists(total), pa.array(used), pa.array(square)]
                yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], *names])
                if rare and not known.all():
                    n = int((~known).sum())
                    columns = [
                        batch.column(0).take(pa.array(doc[~known] + begin)), pa.array(words[~known]), pa.array(tf[~known]),
                        pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[0], *names])
                begin = stop

    return work


def _means(size: int, use_tfidf: bool):
    """The sums of heads and rare words, rows of a key together, to (key, mean)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last key of a batch may go on in the next one

        def result(names: list[str], keys: pa.Array, total: np.ndarray, used: np.ndarray, square: np.ndarray) -> pa.RecordBatch:
            scale = 1.0 / np.maximum(used, 1)
            if use_tfidf:
                scale = np.divide(scale, np.sqrt(square), out=np.zeros(len(scale)), where=square > 0)
            return pa.RecordBatch.from_arrays([keys, _sum_lists(total * scale[:, None])], names)

        for batch in batches:
            names = [batch.schema.names[0], "features"]
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            row = np.repeat(np.arange(len(first)), np.diff(first, append=n))
            word, tf, sums, used, square, idf, vector = batch.columns[1:]
            total = np.zeros((len(first), size))
            heads = np.flatnonzero(word.is_null().to_numpy(zero_copy_only=False))
            _added(total, row[heads], sums.flatten().to_numpy().reshape(-1, size), np.arange(len(heads)), np.ones(len(heads)))
            all_used = np.bincount(row[heads], used.to_numpy(zero_copy_only=False)[heads], len(first)).astype(np.float64)
            all_square = np.bincount(row[heads], square.to_numpy(zero_copy_only=False)[heads], len(first)).astype(np.float64)
            tails = np.flatnonzero(word.is_valid().to_numpy(zero_copy_only=False))
            if len(tails):
                times = tf.to_numpy(zero_copy_only=False)[tails].astype(np.float64)
                idfs = idf.to_numpy(zero_copy_only=False)[tails].astype(np.float64)
                given = vector.is_valid().to_numpy(zero_copy_only=False)[tails]
                usable = given & ~np.isnan(idfs) if use_tfidf else given
                place = np.cumsum(given) - 1
                weight = times * times * idfs if use_tfidf else times
                vectors = vector.flatten().to_numpy().reshape(-1, size)
                _added(total, row[tails][usable], vectors, place[usable], weight[usable])
                all_used += np.bincount(row[tails][usable], times[usable], len(first))
                all_square += np.bincount(row[tails], np.nan_to_num(times * idfs) ** 2, len(first))
            keys = batch.column(0).take(pa.array(first))
            if held is not None:
                if held[0][0].equals(keys[0]):
                    total[0] += held[1][0]
                    all_used[0] += held[2][0]
                    all_square[0] += held[3][0]
                else:
                    yield result(names, *held)
            if len(first) > 1:
                yield result(names, keys.slice(0, len(first) - 1), total[:-1], all_used[:-1], all_square[:-1])
            held = keys.slice(len(first) - 1), total[-1:].copy(), all_used[-1:].copy(), all_square[-1:].copy()
        if held is not None:
            yield result(names, *held)

    return work


def fit_vectorizer(
    df: DataFrame,
    key: str = "url",
    text: str = "content",
    lemmas: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    **word2vec: int,
) -> TextVectorizer:
    """Learn idf and word vectors from ``df``, or take the vectors from a given table."""
    cleaned = materialize(preprocess_texts(df, key, text, lemmas), name="cleaned")
    return fit_cleaned(cleaned, key, lemmas, word_vectors, **word2vec)


def fit_cleaned(
    cleaned: DataFrame,
    key: str = "url",
    lemmas: DataFrame | None = None,
    word_vectors: DataFrame | None = None,
    **word2vec: int,
) -> TextVectorizer:
    """``fit_vectorizer`` on texts that are cleaned already, a table that is read several times."""
    fitted = fit_word_vectors(cleaned, **word2vec) if word_vectors is None else None
    word_vectors = word_vectors if fitted is None else fitted
    idf = inverse_doc_freq(term_counts(cleaned, key), cleaned)
    vocabulary = materialize(
        word_vectors.withColumnRenamed("word", "token").join(idf.select("token", "idf", "df"), "token", "full_outer"),
        name="vocabulary",
    )
    if fitted is not None:
        discard(fitted)
    size, words = vocabulary.agg(F.max(F.size("vector")), F.count("*")).first()
    return TextVectorizer(vocabulary, size if size and size > 0 else 1, words, lemmas)


def mean_pool(token_vectors: DataFrame, key: str, vector: str, mask: Column | None = None) -> DataFrame:
    """(key, vector): mean of the masked token vectors, scaled to unit length."""
    kept = token_vectors if mask is None else token_vectors.where(mask)
    pooled = kept.groupBy(key).agg(mean_vector(as_vector(F.col(vector))).alias("m"))
    return pooled.select(key, as_array(F.col("m")).alias("m")).select(key, l2_normalize(F.col("m")).alias("vector"))
