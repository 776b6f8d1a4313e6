"""Quality rules per document and per host.

Each text is measured and judged by rules of its own; the failures are then added up per host.  A
host's failure rate is shrunk by a beta prior fitted to all hosts (method of moments, each host
weighing alike), so that few documents prove little; documents of hosts whose shrunk rate reaches
``host_limit`` are not kept.

Null and empty texts have no words and fail.  A null host counts as one host.  Repeated rows count
as often as they occur.  With no host, or no spread between hosts, the prior is weak (one failure
and one pass), and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, fresh, require, small_batches
from .texts import Chunk, chunks, concat_columns

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
HOST_LIMIT = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [pa.field(m, pa.int64()) for m in MEASURES]
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def _duplicate_lines(chunk: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    data, offsets = chunk.data, chunk.offsets
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    starts.sort()
    ends.sort()
    text = np.repeat(np.arange(chunk.texts), np.diff(np.searchsorted(breaks, offsets)) + 1)
    words = np.searchsorted(chunk.word_starts, ends) - np.searchsorted(chunk.word_starts, starts)
    full = words > 0
    starts, ends, text = starts[full], ends[full], text[full]
    order = np.lexsort((chunk.byte_hash.spans(starts, ends), ends - starts, text))
    hashes, sizes, text = chunk.byte_hash.spans(starts, ends)[order], (ends - starts)[order], text[order]
    same = (hashes[1:] == hashes[:-1]) & (sizes[1:] == sizes[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[1:][same], minlength=chunk.texts)


def _repeated_words(chunk: Chunk, window: int) -> np.ndarray:
    """Words in windows found twice or more in their text, the first occurrence included, per text."""
    starts, hashes = chunk.window_hashes(window)
    text = np.searchsorted(chunk.word_bounds, starts, "right") - 1
    order = np.lexsort((hashes, text))
    hashes, own = hashes[order], text[order]
    same = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(starts), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(chunk.word_starts) + window, np.int32)
    hit = starts[order][twice]
    np.add.at(covered, hit, 1)
    np.subtract.at(covered, hit + window, 1)
    inside = np.cumsum(covered)[: len(chunk.word_starts)] > 0
    total = np.concatenate([[0], np.cumsum(inside)])
    return np.diff(total[chunk.word_bounds])


def measure_texts(texts: pa.Array) -> pa.Array:
    parts = []
    for chunk in chunks(texts):
        letters = (chunk.data & 0xC0) != 0x80
        parts.append(
            {
                "n_words": np.diff(chunk.word_bounds),
                "word_chars": chunk.per_text(letters & ~chunk.is_space),
                "n_symbols": chunk.per_text(_IS_SYMBOL[chunk.data]),
                "n_dup_lines": _duplicate_lines(chunk),
                "n_repeat_words": _repeated_words(chunk, WINDOW),
            }
        )
    return concat_columns(parts, FIELDS)


def measured(df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """Adds the struct ``name`` with the measures of each text."""
    measure = F.arrow_udf(measure_texts, ", ".join(f"{m} long" for m in MEASURES))
    return df.withColumn(name, measure(column(text_col)))


def host_verdicts(failures: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, failed) rows to one row per host: documents, failures, shrunk rate, verdict.

    The prior's mean is the mean m of the hosts' rates, its strength m(1-m)/v - 1 from their
    variance v; where v is 0 or too large for a beta distribution the strength is 2.
    """
    hosts = failures.groupBy("host").agg(
        F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("long")).alias("host_failed")
    )
    rate = F.col("host_failed") / F.col("host_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    spread = F.col("m") * (1 - F.col("m"))
    prior = moments.select(
        F.struct(
            F.when(spread > 0, F.col("m")).otherwise(0.5).alias("mean"),
            F.when((F.col("v") > 0) & (spread > F.col("v")), spread / F.col("v") - 1).otherwise(2.0).alias("strength"),
        )
    ).scalar()
    weight = F.col("_prior.strength")
    shrunk = (F.col("host_failed") + F.col("_prior.mean") * weight) / (F.col("host_docs") + weight)
    return (
        hosts.withColumn("_prior", prior)
        .withColumn("host_rate", shrunk)
        .withColumn("host_kept", F.col("host_rate") < host_limit)
        .drop("_prior")
    )


def judge_documents(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    host_limit: float = HOST_LIMIT,
) -> DataFrame:
    """All columns of ``docs`` and one struct ``quality``, the last column: the measures,
    ``base_failed``, the host's documents, failures and shrunk rate, and ``kept``.

    Texts are measured twice rather than shuffled: once for the hosts' counts, which are added up
    before they leave a task, and once for the result, joined with one row per host.
    """
    require(docs, [text_col, host_col])
    small_batches(docs.sparkSession)
    mark, key = fresh(docs, "quality", "quality_host")
    judged = measured(docs, mark, text_col)
    words, repeats = F.col(f"{mark}.n_words"), F.col(f"{mark}.n_repeat_words")
    judged = judged.withColumn(
        mark,
        F.struct(f"{mark}.*", ((words < min_words) | (100 * repeats > max_repeat_percent * words)).alias("base_failed")),
    )
    failures = judged.select(column(host_col).alias("host"), F.col(f"{mark}.base_failed").alias("failed"))
    verdicts = host_verdicts(failures, host_limit).select(F.struct("*").alias(key))
    joined = judged.join(verdicts, F.col(f"{key}.host").eqNullSafe(column(host_col)))
    kept = ~F.col(f"{mark}.base_failed") & F.col(f"{key}.host_kept")
    return joined.withColumn(
        mark,
        F.struct(f"{mark}.*", f"{key}.host_docs", f"{key}.host_failed", f"{key}.host_rate", kept.alias("kept")),
    ).drop(key)
