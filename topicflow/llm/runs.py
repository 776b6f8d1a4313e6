"""Sorted runs of hashed keys that tasks exchange, and the anchors that stand for repeated windows.

A task works on one chunk of texts at a time.  Its keys are sorted, cut by ranges of the key into
parts, and each part leaves as one row: the sorted keys as differences, and for each key which text
and which place it belongs to.  A key that a chunk holds many times leaves it once, so the rows of a
key are at most as many as the chunks, however often it occurs.  The number of parts follows the
number of keys; parts are read one at a time.

A text is known by its id and a hash of its content, in that order; a null id comes last.  So rows
that repeat an id and its text are one text, which does not repeat itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, small_batches
from .texts import U64, Chunk, RollingHash, chunks, mix, runs

KEYS_PER_PART = 100_000
PARTS_PER_TASK = 4
LAST_ID = (1 << 63) - 1
RUN_SCHEMA = (
    "part integer, n integer, ids binary, hashes binary, keys binary, after binary, before binary, text binary, place binary"
)
_RUN_NAMES = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
PLACES_SCHEMA = "id long, hash long, places array<int>"
TEXT_KEYS = ["id", "hash"]

# a key leaves each chunk once, so larger chunks send fewer rows
CHUNK_BYTES = 2 << 20


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash, text): the key of a text as described above; null texts are empty."""
    small_batches(docs.sparkSession)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    key = F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID))
    return docs.select(key.alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def parts_for(keys: int, per_part: int = KEYS_PER_PART) -> int:
    return max(1, -(-keys // per_part))


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, as many as the largest number needs."""
    values = values.astype("<u8", copy=False)
    used = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return values.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(parts)) >> U64(32)


def place_lists(ids: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """One row per text with its places in order."""
    order = np.lexsort((places, hashes, ids))
    ids, hashes, places = ids[order], hashes[order], places[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    offsets = pa.array(np.append(at, len(ids)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(hashes[at]), lists], ["id", "hash", "places"])


def run_rows(
    parts: int,
    ids: np.ndarray,
    hashes: np.ndarray,
    keys: np.ndarray,
    text: np.ndarray,
    place: np.ndarray,
    after: np.ndarray | None = None,
    before: np.ndarray | None = None,
) -> pa.RecordBatch:
    """Rows of one chunk from keys in ascending order; ``ids`` and ``hashes`` are those of its texts."""
    part = part_of(keys, parts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows: list[list] = [[] for _ in _RUN_NAMES]
    for a, b in zip([0, *cuts], [*cuts, len(keys)]):
        if a == b:
            continue
        used, own = np.unique(text[a:b], return_inverse=True)
        values = [
            int(part[a]),
            b - a,
            ids[used].tobytes(),
            hashes[used].tobytes(),
            squeeze(np.diff(keys[a:b], prepend=U64(0))),
            squeeze(after[a:b]) if after is not None else b"",
            squeeze(before[a:b]) if before is not None else b"",
            squeeze(own),
            squeeze(place[a:b]),
        ]
        for column_, value in zip(rows, values):
            column_.append(value)
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], _RUN_NAMES)


def known_rows(parts: int, ids: np.ndarray, hashes: np.ndarray, text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Places that a chunk has already decided, one row per chunk, spread over negative parts."""
    used, own = np.unique(text, return_inverse=True)
    part = -1 - int(U64(int(hashes[used].astype(U64).sum())) % U64(parts))
    values = [part, len(text), ids[used].tobytes(), hashes[used].tobytes(), b"", b"", b"", squeeze(own), squeeze(place)]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], _RUN_NAMES)


def by_part(batches: Iterator[pa.RecordBatch], position: int = 0) -> Iterator[list[pa.RecordBatch]]:
    """The rows of a sorted partition, part by part."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        parts = batch.column(position).to_numpy()
        cuts = np.flatnonzero(np.diff(parts)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a == b:
                continue
            if held and parts[a] != at:
                yield held
                held = []
            at = parts[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def _entries(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("id", "hash", "key", "after", "before", "place")}
    for batch in held:
        for row in batch.to_pylist():
            n = row["n"]
            text = widen(row["text"], n).astype(np.int64)
            found["id"].append(np.frombuffer(row["ids"], np.int64)[text])
            found["hash"].append(np.frombuffer(row["hashes"], np.int64)[text])
            found["place"].append(widen(row["place"], n).astype(np.int64))
            found["key"].append(np.cumsum(widen(row["keys"], n)) if row["keys"] else np.zeros(n, U64))
            for name in ("after", "before"):
                found[name].append(widen(row[name], n).astype(np.uint32) if row[name] else np.zeros(n, np.uint32))
    return {k: np.concatenate(v) for k, v in found.items()}


def exchanged(rows: DataFrame, parts: int, decide: Callable[[dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """Brings the runs of each part together; (id, hash, places) of the entries that ``decide`` marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            entries = _entries(held)
            marked = decide(entries) if held[0].column(0)[0].as_py() >= 0 else np.ones(len(entries["id"]), bool)
            if marked.any():
                yield place_lists(entries["id"][marked], entries["hash"][marked], entries["place"][marked])

    placed = rows.repartition(-(-parts // PARTS_PER_TASK), "part").sortWithinPartitions("part")
    return placed.mapInArrow(work, PLACES_SCHEMA)


def gathered(places: DataFrame) -> DataFrame:
    """One row per text with all its places, in order and without repeats."""
    lists = F.flatten(F.collect_list("places"))
    return places.groupBy(*TEXT_KEYS).agg(F.array_sort(F.array_distinct(lists)).alias("places"))


def sliding(values: np.ndarray, width: int, best: np.ufunc, neutral: int) -> np.ndarray:
    """The best of each ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, values.dtype)
    rows = np.concatenate([values, np.full(-n % width, neutral, values.dtype)]).reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    behind = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: RollingHash, bounds: np.ndarray, base: int, target: int) -> np.ndarray:
    """Places of the anchors: of each window of ``target`` codes in one text, the window of ``base``
    codes in it with the smallest hash.  Equal windows have equal anchors, wherever they occur."""
    small = hashes.windows(base)
    width = target - base + 1
    if len(small) < width:
        return np.zeros(0, np.int64)
    small |= U64(1)
    least = sliding(small, width, np.minimum, 2**64 - 1)
    starts = runs(bounds[:-1], np.maximum(np.diff(bounds) - target + 1, 0))
    valid = np.zeros(len(least), bool)
    valid[starts] = True
    least[~valid] = 0
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    return np.flatnonzero(sliding(padded, width, np.maximum, 0) == small)


def _matched(entries: dict[str, np.ndarray]) -> np.ndarray:
    """Entries whose anchor is repeated together with what follows or what precedes it."""
    marked = np.zeros(len(entries["key"]), bool)
    for side in ("after", "before"):
        order = np.lexsort((entries[side], entries["key"]))
        key, value = entries["key"][order], entries[side][order]
        same = (key[1:] == key[:-1]) & (value[1:] == value[:-1]) & (value[1:] > 0)
        marked[order[1:][same]] = True
        marked[order[:-1][same]] = True
    return marked


def repeated_anchors(
    texts: DataFrame,
    codes: Callable[[Chunk], tuple[RollingHash, np.ndarray]],
    base: int,
    longer: int,
    target: int,
    parts: int,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """(id, hash, places) of the anchors that may lie in a repeated window of ``target`` codes.

    ``codes`` gives the rolling hash of a chunk's codes and the texts' bounds in it.  Anchors of
    ``base`` codes that are repeated are extended to ``longer`` codes, forwards and backwards; those
    stay that are repeated in one direction.  With longer <= (base + target + 1) / 2, a window of
    ``target`` codes holds one of the two extensions of its anchor, so none is lost.  The extensions
    are told apart by 15 bits: chance may keep an anchor, never drop one.
    """
    assert 2 * longer <= base + target + 1
    extra = longer - base

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in chunks(batch.column(2), chunk_bytes):
                hashes, bounds = codes(chunk)
                ids = all_ids[chunk.first : chunk.first + chunk.texts]
                marks = all_hashes[chunk.first : chunk.first + chunk.texts]
                at = anchors(hashes, bounds, base, target)
                if not len(at):
                    continue
                text = np.searchsorted(bounds, at, "right") - 1
                # anchors have small hashes: mixed again, their keys fall evenly into the parts
                keys = mix(hashes.spans(at, at + base))
                sides = []
                for low, high, inside in (
                    (at, at + longer, at + longer <= bounds[text + 1]),
                    (at - extra, at + base, at - extra >= bounds[text]),
                ):
                    short = np.zeros(len(at), np.uint32)
                    short[inside] = (hashes.spans(low[inside], high[inside]) >> U64(49)).astype(np.uint32) + 1
                    sides.append(short)
                order = np.lexsort((sides[1], sides[0], keys))
                key, after, before = keys[order], sides[0][order], sides[1][order]
                new = np.ones(len(at), bool)
                new[1:] = (key[1:] != key[:-1]) | (after[1:] != after[:-1]) | (before[1:] != before[:-1])
                place = (at - bounds[text])[order]
                text = text[order]
                group = np.cumsum(new) - 1
                often = np.bincount(group)[group] > 1
                often &= (after > 0) | (before > 0)
                yield run_rows(parts, ids, marks, key[new], text[new], place[new], after[new], before[new])
                if often.any():
                    yield known_rows(parts, ids, marks, text[often], place[often])

    return gathered(exchanged(texts.mapInArrow(work, RUN_SCHEMA), parts, _matched))


def later_places(ids: np.ndarray, hashes: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): entries sorted by key, then by text and place; later: the key came before.

    The same place twice is no repeat of itself.
    """
    order = np.lexsort((places, hashes, ids, keys))
    key, i, h, p = keys[order], ids[order], hashes[order], places[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (i != i[first]) | (h != h[first]) | (p != p[first])


def later_entries(entries: dict[str, np.ndarray]) -> np.ndarray:
    order, later = later_places(entries["id"], entries["hash"], entries["key"], entries["place"])
    marked = np.zeros(len(order), bool)
    marked[order] = later
    return marked
