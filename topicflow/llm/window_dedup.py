"""Removal of repeated windows of words, found level by level.

Windows of a quarter of the length are looked at first, at anchors only (see ``runs``): those that
are repeated are extended to half the length, forwards and backwards, and those repeated at that
length to the whole length, at all their starts.  A window of the whole length that is repeated
survives all levels, so nothing is lost.  At the whole length the first occurrence in the order of
id and place stays; each word that a later one covers is removed.  Longer repeats are unions of
repeated windows, so the doubling ends there.

Words are compared unchanged.  Null and empty texts have no words.  Repeats inside one text count.
Rows that repeat an id and its text get the same result; with one id and different texts, the order
is that of a hash of the text.  A null id comes last.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .frames import require
from .runs import (
    KEYS_PER_PART,
    LAST_ID,
    RUN_SCHEMA,
    TEXT_KEYS,
    exchanged,
    gathered,
    keyed_texts,
    known_rows,
    later_entries,
    later_places,
    parts_for,
    repeated_anchors,
    run_rows,
)
from .texts import Chunk, RollingHash, chunks, runs

LENGTH = 20
BYTES_PER_WORD = 6  # only sizes the exchange


def _word_codes(chunk: Chunk) -> tuple[RollingHash, np.ndarray]:
    return RollingHash(chunk.word_hashes), chunk.word_bounds


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of a list column; nulls are empty."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts


def _starts_near(places: np.ndarray, text: np.ndarray, bounds: np.ndarray, base: int, length: int) -> np.ndarray:
    """Starts of the windows of ``length`` words that hold an anchor at one of the places."""
    low = np.maximum(places - (length - base), bounds[text])
    high = np.minimum(places, bounds[text + 1] - length)
    wanted = high >= low
    return np.unique(runs(low[wanted], high[wanted] - low[wanted] + 1))


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, text) to (id, hash, places): starts of windows that also start earlier."""
    base, longer = max(1, length // 4), max(1, length // 2)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(total // BYTES_PER_WORD // max(1, (length - base) // 2))
    found = materialize(repeated_anchors(texts, _word_codes, base, longer, length, parts), name="anchors")
    kept = found.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = parts_for(kept * max(1, (length - base) // 2), KEYS_PER_PART)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, counts = flat_lists(batch.column(3))
            before = np.concatenate([[0], np.cumsum(counts)])
            for chunk in chunks(batch.column(2)):
                codes, bounds = _word_codes(chunk)
                mine = slice(chunk.first, chunk.first + chunk.texts)
                ids, marks = all_ids[mine], all_hashes[mine]
                text = np.repeat(np.arange(chunk.texts), counts[mine])
                own = places[before[mine.start] : before[mine.stop]] + bounds[text]
                starts = _starts_near(own, text, bounds, base, length)
                if not len(starts):
                    continue
                text = np.searchsorted(bounds, starts, "right") - 1
                place = starts - bounds[text]
                keys = codes.spans(starts, starts + length)
                order, later = later_places(ids[text], marks[text], keys, place)
                key, text, place = keys[order], text[order], place[order]
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                yield run_rows(parts, ids, marks, key[new], text[new], place[new])
                if later.any():
                    yield known_rows(parts, ids, marks, text[later], place[later])

    candidates = texts.join(found, TEXT_KEYS).select(*TEXT_KEYS, "text", "places")
    return gathered(exchanged(candidates.mapInArrow(work, RUN_SCHEMA), parts, later_entries))


def _cut(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = flat_lists(batch.column(2))
            before = np.concatenate([[0], np.cumsum(counts)])
            for chunk in chunks(batch.column(1)):
                bounds, starts, ends = chunk.word_bounds, chunk.word_starts, chunk.word_ends
                mine = slice(chunk.first, chunk.first + chunk.texts)
                text = np.repeat(np.arange(chunk.texts), counts[mine])
                own = places[before[mine.start] : before[mine.stop]] + bounds[text]
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, own, 1)
                np.subtract.at(cover, np.minimum(own + length, len(starts)), 1)
                removed = np.cumsum(cover)[:-1] > 0
                kept = ~removed
                sizes = (ends - starts)[kept] + 1  # a word and the space behind it
                pool = np.append(chunk.data, np.uint8(0x20))
                out = pool[runs(starts[kept], sizes)]
                stops = np.cumsum(sizes)
                out[stops - 1] = 0x20
                kept_before = np.concatenate([[0], np.cumsum(kept)])[bounds]
                at = np.concatenate([[0], stops])[kept_before]
                body = out.tobytes()
                joined = [body[a : max(a, b - 1)].decode() for a, b in zip(at, at[1:])]
                words = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.texts),
                        pa.array(words.astype(np.int64)),
                        pa.array((words - np.diff(kept_before)).astype(np.int64)),
                        pa.array(joined),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return work


def remove_repeated_windows(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space): a row per row of ``docs``."""
    require(docs, [id_col, text_col])
    texts = keyed_texts(docs, id_col, text_col)
    later = repeated_starts(texts, length)
    joined = texts.join(later, TEXT_KEYS, "left")
    cut = joined.select("id", "text", "places").mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))
