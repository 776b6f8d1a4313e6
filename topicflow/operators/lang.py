"""Language detection from letter trigrams, trained on labelled texts.

Trigrams fall into a fixed number of slots, so a profile has ``SLOTS`` rows whatever the
corpus, and is written once as a stage table that later runs read.  Lower-casing and letter
selection are built-in expressions; the trigrams of a batch of texts are counted and scored by
array operations on all texts of the batch at once, so that no trigram becomes a row.  Scoring
shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, small_batches

SLOTS = 1 << 14
SMOOTHING = 0.5
NOT_LETTERS = r"[^\p{L}]+"


def letters(text: Column) -> Column:
    """Lower-case letters with one space between words and at both ends."""
    words = F.trim(F.regexp_replace(F.lower(text), NOT_LETTERS, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


# numbers of 64 bits for each of them, several at a time
BATCH_CHARACTERS = 1 << 18


def trigram_slots(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, slots, bounds) for consecutive texts: the slots of every run of three characters
    in one text, and where each text's slots begin.  Nulls have none."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        before = ends[first] - lengths[first]
        stop = max(int(np.searchsorted(ends, before + BATCH_CHARACTERS, "right")), first + 1)
        joined = "".join(pc.fill_null(texts.slice(first, stop - first), "").to_pylist())
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        slots = ((codes[:-2] * 1021 + codes[1:-1]) * 1021 + codes[2:]) & (SLOTS - 1) if len(codes) > 2 else codes[:0]
        # runs that begin in the last two characters of a text reach into the next one
        own = lengths[first:stop]
        text = np.repeat(np.arange(stop - first), own)[: len(slots)]
        inside = np.arange(len(slots)) + 2 < np.cumsum(own)[text]
        bounds = np.concatenate([[0], np.cumsum(np.maximum(own - 2, 0))])
        yield first, slots[inside], bounds
        first = stop


def fit_language_profiles(labelled: DataFrame, languages: Sequence[str], text: str = "content") -> DataFrame:
    """One row per slot: smoothed log probabilities, one per language in the given order."""
    small_batches(labelled.sparkSession)
    index = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one task sends at most SLOTS rows per language
        counts = np.zeros((len(index), SLOTS), dtype=np.int64)
        names = pa.array(list(index), pa.string())
        for batch in batches:
            codes = pc.fill_null(pc.index_in(batch.column(0), names), -1).to_numpy(zero_copy_only=False)
            for first, slots, bounds in trigram_slots(batch.column(1)):
                lang = np.repeat(codes[first : first + len(bounds) - 1], np.diff(bounds))
                known = lang >= 0
                counts += np.bincount(lang[known] * SLOTS + slots[known], minlength=counts.size).reshape(counts.shape)
        lang, slot = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(lang, pa.int32()), pa.array(slot, pa.int32()), pa.array(counts[lang, slot])],
            ["lang", "slot", "n"],
        )

    counted = labelled.select("lang", letters(F.col(text)).alias("t")).mapInArrow(count, "lang int, slot int, n long")
    counts = counted.groupBy("slot").agg(
        *(F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(index)))
    )
    slots = labelled.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    total = counts.agg(F.array(*(F.sum(f"n{i}") for i in range(len(index))))).scalar()
    logs = [
        F.log((F.coalesce(F.col(f"n{i}"), F.lit(0)) + SMOOTHING) / (total[i] + SMOOTHING * SLOTS))
        for i in range(len(index))
    ]
    profiles = slots.join(counts, "slot", "left").select("slot", F.array(*logs).alias("log_p"))
    return materialize(profiles, name="profiles")


def language_of(profiles: DataFrame, languages: Sequence[str]):
    """A column function: text → (language, score); null for a text without trigrams."""
    small_batches(profiles.sparkSession)
    table = profiles.toArrow().sort_by("slot")  # SLOTS rows by construction
    log_p = np.array(table.column("log_p").to_pylist()).T.copy()
    names = pa.array(languages, pa.string())

    @F.arrow_udf("language string, score double")
    def score(texts: pa.Array) -> pa.Array:
        best, shares = [], []
        for _, slots, bounds in trigram_slots(texts):
            known = np.diff(bounds) > 0
            sums = np.zeros((len(known), len(log_p)))
            if known.any():
                for i, of_lang in enumerate(log_p):
                    sums[known, i] = np.add.reduceat(of_lang[slots], bounds[:-1][known])
            weights = np.exp(sums - sums.max(axis=1, keepdims=True))
            best.append(np.where(known, sums.argmax(axis=1), -1))
            shares.append(np.where(known, 1.0 / weights.sum(axis=1), np.nan))
        code = np.concatenate(best) if best else np.zeros(0, np.int64)
        share = np.concatenate(shares) if shares else np.zeros(0)
        found = pc.take(names, pa.array(code, mask=code < 0))
        return pa.StructArray.from_arrays([found, pa.array(share, mask=code < 0)], ["language", "score"])

    # not to be repeated by filters that are pushed below
    once = score.asNondeterministic()
    return lambda text: once(letters(text))


def detect_language(
    df: DataFrame, profiles: DataFrame, languages: Sequence[str], key: str = "url", text: str = "content"
) -> DataFrame:
    """(key, language, score): the most likely language and its probability."""
    found = language_of(profiles, languages)(F.col(text))
    return df.select(key, found.alias("found")).select(key, "found.*").where("language IS NOT NULL")


def select_language(
    df: DataFrame,
    profiles: DataFrame,
    languages: Sequence[str],
    lang: str = "en",
    min_score: float = 0.95,
    text: str = "content",
) -> DataFrame:
    found = df.withColumn("_found", language_of(profiles, languages)(F.col(text)))
    return found.where((F.col("_found.language") == lang) & (F.col("_found.score") >= min_score)).drop("_found")
