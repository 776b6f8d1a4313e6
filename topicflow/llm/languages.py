"""Language identification with bit-sliced Bloom filters of n-grams.

Per language a set of byte n-grams is learned: those that make up at least ``min_share`` of its
n-grams and are not much rarer there than in the language that uses them most.  All sets share one
Bloom filter whose slots hold a bit per language, so that a lookup returns the mask of all
languages that contain the n-gram.  A text's masks are counted per language, the counts are
corrected for the false positives that the fill of each language's slice lets expect, and the
largest one decides.

Texts without a letter and nulls are ``und`` with score 0.  Texts too short for an n-gram, and
texts none of whose n-grams are known, get the most frequent language with score 0.  With no
labelled rows every text is ``und``.  Equal counts go to the more frequent language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import column, fresh, hash_order, require, small_batches
from .texts import U64, Chunk, chunks, mix

ORDERS = (3, 4)
MIN_SHARE = 2e-5
RIVAL_SHARE = 0.35
SLOTS_PER_GRAM = 16
HASHES = 3
# at most about this many labelled rows per language are read for fitting, chosen by hash
SAMPLE_PER_LANGUAGE = 4000
UNKNOWN = "und"

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:0x41] = 0x20
_PLAIN[0x41:0x5B] += 0x20
_PLAIN[[*range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of all n-grams of the texts, ASCII letters in lower case and any
    other ASCII character as a space; an n-gram is its bytes and its order in one number."""
    data = _PLAIN[chunk.data].astype(U64)
    owner = np.repeat(np.arange(chunk.texts), np.diff(chunk.offsets))
    texts, keys = [], []
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            continue
        key = np.full(n, order, U64)
        for i in range(order):
            key <<= U64(8)
            key |= data[i : i + n]
        inside = owner[:n] == owner[order - 1 :]
        # runs of spaces say nothing
        inside &= (data[:n] != 0x20) | (data[1 : n + 1] != 0x20)
        texts.append(owner[:n][inside])
        keys.append(key[inside])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    return np.concatenate(texts), np.concatenate(keys)


@dataclass
class LanguageFilters:
    """``table[slot, i]`` holds the bits of languages 64 * i .. 64 * i + 63."""

    languages: list[str]
    table: np.ndarray

    def slots(self, keys: np.ndarray) -> list[np.ndarray]:
        hashed = mix(keys)
        step = (hashed >> U64(32)) | U64(1)
        return [((hashed + U64(i) * step) & U64(len(self.table) - 1)).astype(np.int64) for i in range(HASHES)]

    def add(self, language: int, keys: np.ndarray) -> None:
        bit = U64(1) << U64(language % 64)
        for slots in self.slots(keys):
            self.table[slots, language // 64] |= bit

    def false_positive_rates(self) -> np.ndarray:
        fill = [
            ((self.table[:, i // 64] >> U64(i % 64)) & U64(1)).mean() for i in range(len(self.languages))
        ]
        return np.array(fill) ** HASHES

    def counts(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """n-grams per text, and per text and language how many of them the language contains."""
        text, keys = grams(chunk)
        total = np.bincount(text, minlength=chunk.texts)
        found = np.zeros((chunk.texts, len(self.languages)))
        slots = self.slots(keys)
        for word in range(self.table.shape[1]):
            slice_ = self.table[:, word]
            mask = slice_[slots[0]]
            for more in slots[1:]:
                mask &= slice_[more]
            for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                has = ((mask >> U64(i % 64)) & U64(1)).astype(bool)
                found[:, i] = np.bincount(text[has], minlength=chunk.texts)
        return total, found


def _sampled(rows: DataFrame, per_language: int) -> DataFrame:
    """(id, text, lang) rows, at most about ``per_language`` of a language, chosen by hash."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    joined = rows.join(F.broadcast(counts), "lang")  # one row per language
    return joined.where(hash_order(F.col("id"), 5) * F.col("_n") < per_language).select("lang", "text")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        names = langs.dictionary
        for chunk in chunks(batch.column(1)):
            text, keys = grams(chunk)
            lang = codes[chunk.first + text] if len(text) else text
            for code in np.unique(lang):
                own, counts = np.unique(keys[lang == code], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pc.take(names, pa.array(np.full(len(own), code))),
                        pa.array(own.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["lang", "gram", "n"],
                )


def fit_languages(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageFilters | None:
    """Filters from (id, text, lang) rows; rows with a null text or lang are left out.

    The n-grams kept of one language are at most ``1 / MIN_SHARE``, whatever the corpus,
    so the table that the driver builds has a size known beforehand.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = (
        _sampled(rows, per_language)
        .mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counted.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = (
        shares.where(F.col("share") >= MIN_SHARE)
        .join(best, "gram")
        .where(F.col("share") >= RIVAL_SHARE * F.col("best"))
        .select("lang", "gram", "total")
        .toArrow()
    )
    if not kept.num_rows:
        return None
    langs = kept["lang"].to_numpy(zero_copy_only=False)
    gram = kept["gram"].to_numpy().view(U64)
    totals = dict(zip(langs, kept["total"].to_numpy()))
    names = sorted(totals, key=lambda name: (-totals[name], name))
    largest = max(int((langs == name).sum()) for name in names)
    slots = 1 << int(SLOTS_PER_GRAM * largest - 1).bit_length()
    filters = LanguageFilters(names, np.zeros((slots, -(-len(names) // 64)), U64))
    for i, name in enumerate(names):
        filters.add(i, gram[langs == name])
    return filters


def predict(df: DataFrame, filters: LanguageFilters | None, text: Column, name: str) -> DataFrame:
    """Adds the struct ``name`` (lang, score)."""
    if filters is None:
        return df.withColumn(name, F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score")))
    rates = filters.false_positive_rates()
    shared = df.sparkSession.sparkContext.broadcast(filters)

    def score(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for chunk in chunks(texts):
            total, found = shared.value.counts(chunk)
            corrected = np.maximum((found - total[:, None] * rates) / (1 - rates), 0)
            best = corrected.argmax(axis=1)
            sums = corrected.sum(axis=1)
            langs.append(best)
            scores.append(np.where(sums > 0, corrected.max(axis=1) / np.maximum(sums, 1e-12), 0.0))
        names = pa.array(shared.value.languages)
        at = np.concatenate(langs) if langs else np.zeros(0, np.int64)
        values = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pc.take(names, pa.array(at)), pa.array(values)], ["lang", "score"])

    udf = F.arrow_udf(score, "lang string, score double")
    none = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    lettered = F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))
    return df.withColumn(name, udf(text)).withColumn(name, F.when(lettered, F.col(name)).otherwise(none))


def identify_languages(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """All columns of ``docs`` and one struct ``language`` (lang, score), the last column.

    Filters are learned from the rows where ``train`` holds; a prediction reads the text alone.
    """
    require(docs, [id_col, text_col, lang_col])
    small_batches(docs.sparkSession)
    labelled = docs.where(train).select(
        column(id_col).alias("id"), column(text_col).cast("string").alias("text"), column(lang_col).cast("string").alias("lang")
    )
    (name,) = fresh(docs, "language")
    return predict(docs, fit_languages(labelled, per_language), column(text_col).cast("string"), name)
