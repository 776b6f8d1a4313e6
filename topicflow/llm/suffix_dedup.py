"""Removal of repeated byte strings with sorted suffixes, merged by common prefixes.

Of all suffixes those are sorted that start at an anchor (see ``runs``): every repeated string of
``length`` bytes holds one, with up to ``length - BASE`` bytes on its left.  Anchors that are not
repeated, or not together with enough bytes on one side, drop out before any suffix is moved.

A task sorts the suffixes of a chunk, cuts them to ``length`` bytes and sends them as front-coded
runs: for each suffix the length of the prefix it shares with the one before, and the rest, with
the bytes on its left beside it.  Equal contexts leave a chunk once, as their earliest occurrence;
the others are known to be repeated.  A part merges its runs with a loser tree that carries, for
each run, the prefix its next suffix shares with the last one put out: the larger prefix wins
without a look at the strings, and equal ones are compared from that prefix on only.

Of the merged suffixes, those that share enough bytes to the right, and are equal in the bytes on
the left that complete ``length`` bytes, hold one string; all but the earliest in the order of id
and place are removed.  Strings are judged on the input; overlaps count, texts do not touch.

Null and empty texts stay empty.  Rows that repeat an id and its text get the same result; with one
id and different texts, the order is that of a hash of the text.  A null id comes last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .frames import column, fresh, require
from .runs import (
    LAST_ID,
    PARTS_PER_TASK,
    TEXT_KEYS,
    by_part,
    keyed_texts,
    part_of,
    parts_for,
    repeated_anchors,
    squeeze,
    widen,
)
from .texts import U64, Chunk, RollingHash, chunks, mix, runs
from .window_dedup import flat_lists

LENGTH = 100
SUFFIXES_PER_PART = 30_000
CHUNK_BYTES = 1 << 19
SPAN_SCHEMA = "id long, hash long, starts array<int>, ends array<int>"
SUFFIX_SCHEMA = "part integer, n integer, ids binary, hashes binary, text binary, place binary, strings binary"


def anchor_size(length: int) -> int:
    return max(1, length * 24 // 100)


def _byte_codes(chunk: Chunk) -> tuple[RollingHash, np.ndarray]:
    return chunk.byte_hash, chunk.offsets


def front_code(suffixes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Prefixes shared with the row before, and the remaining bytes, of sorted rows of bytes."""
    n, width = suffixes.shape
    shared = np.zeros(n, np.uint8)
    if n > 1:
        differ = suffixes[1:] != suffixes[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    rest = np.arange(width) >= shared[:, None]
    return shared, suffixes[rest].tobytes()


def front_decode(shared: np.ndarray, rest: bytes, width: int) -> list[bytes]:
    out, at, last = [], 0, b""
    for own in shared.tolist():
        stop = at + width - own
        last = last[:own] + rest[at:stop]
        out.append(last)
        at = stop
    return out


def merge_runs(strings: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs with a loser tree.

    Returns the runs in the order in which they give their next string, and for each string put out
    the prefix it shares with the one before.  ``shared`` has the same within each run.
    """
    k = len(strings)
    size = 1 << max(0, k - 1).bit_length()
    heads = [0] * size
    lengths = [len(s) for s in strings] + [0] * (size - k)
    # -1 marks a run that is over; otherwise the prefix shared with the last string put out
    known = [0 if n else -1 for n in lengths]
    nexts: list[bytes] = [s[0] if s else b"" for s in strings] + [b""] * (size - k)
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        at = known[a]
        if at < 0:
            return a, b
        x, y = nexts[a][at:], nexts[b][at:]
        if x == y:
            # equal strings: the run named first goes first, the other shares all of it
            if a > b:
                a, b = b, a
            known[b] = at + len(x)
            return a, b
        gap = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        common = at + (8 * len(x) - gap.bit_length()) // 8
        if x > y:
            a, b = b, a
        known[b] = common
        return a, b

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        for node in range(level):
            winners[node], loser[level + node] = play(winners[2 * node], winners[2 * node + 1])
    champion = winners[0]
    order, prefixes = [], []
    while known[champion] >= 0:
        order.append(champion)
        prefixes.append(known[champion])
        at = heads[champion] = heads[champion] + 1
        if at < lengths[champion]:
            nexts[champion] = strings[champion][at]
            known[champion] = shared[champion][at]
        else:
            known[champion] = -1
        node = (champion + size) // 2
        while node:
            other = loser[node]
            mine, theirs = known[champion], known[other]
            if theirs > mine:
                loser[node], champion = champion, other
            elif theirs == mine and mine >= 0:
                champion, loser[node] = play(champion, other)
            node //= 2
    return order, prefixes


def _contexts(chunk: Chunk, at: np.ndarray, text: np.ndarray, length: int, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Right and left bytes of the anchors, filled with zeros beyond the text, and their sizes."""
    ends, begins = chunk.offsets[text + 1], chunk.offsets[text]
    right_sizes = np.minimum(ends - at, length)
    left_sizes = np.minimum(at - begins, left)
    padded = np.concatenate([np.zeros(left, np.uint8), chunk.data, np.zeros(length, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, left + length)[at]
    lefts = windows[:, :left] * (np.arange(left) >= left - left_sizes[:, None])
    rights = windows[:, left:] * (np.arange(length) < right_sizes[:, None])
    return rights, lefts, right_sizes, left_sizes


def span_lists(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """One row per text with its spans."""
    order = np.lexsort((starts, hashes, ids))
    ids, hashes, starts, ends = ids[order], hashes[order], starts[order], ends[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    offsets = pa.array(np.append(first, len(ids)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(hashes[first]), *lists], ["id", "hash", "starts", "ends"])


def _packed(part: int, ids, hashes, text, place, payload: bytes) -> list:
    used, own = np.unique(text, return_inverse=True)
    return [part, len(text), ids[used].tobytes(), hashes[used].tobytes(), squeeze(own), squeeze(place), payload]


def _suffix_batch(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
    names = [f.split()[0] for f in SUFFIX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names)


def _sorted_runs(length: int, parts: int):
    """(id, hash, text, places) to front-coded runs, and the spans a chunk has decided itself."""
    base = anchor_size(length)
    left = length - base

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_ids, all_hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, counts = flat_lists(batch.column(3))
            before = np.concatenate([[0], np.cumsum(counts)])
            for chunk in chunks(batch.column(2), CHUNK_BYTES):
                mine = slice(chunk.first, chunk.first + chunk.texts)
                ids, marks = all_ids[mine], all_hashes[mine]
                text = np.repeat(np.arange(chunk.texts), counts[mine])
                place = places[before[mine.start] : before[mine.stop]]
                if not len(place):
                    continue
                at = place + chunk.offsets[text]
                keys = mix(chunk.byte_hash.spans(at, at + base))  # spread as in repeated_anchors
                low = np.maximum(at - left, chunk.offsets[text])
                high = np.minimum(at + length, chunk.offsets[text + 1])
                whole = chunk.byte_hash.spans(low, high) ^ mix((at - low).astype(U64) << U64(32) | (high - at).astype(U64))
                # equal contexts: the earliest stands for all
                order = np.lexsort((place, marks[text], ids[text], whole))
                new = np.ones(len(order), bool)
                new[1:] = whole[order][1:] != whole[order][:-1]
                first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
                again = (ids[text[first]] != ids[text[order]]) | (marks[text[first]] != marks[text[order]]) | (place[first] != place[order])
                known = order[again]
                rows = []
                if len(known):
                    ends = squeeze((high - chunk.offsets[text])[known])
                    starts = (low - chunk.offsets[text])[known]
                    spread = int(U64(int(marks[text[known]].astype(U64).sum())) % U64(parts))
                    rows.append(_packed(-1 - spread, ids, marks, text[known], starts, ends))
                own = order[new]
                rights, lefts, right_sizes, left_sizes = _contexts(chunk, at[own], text[own], length, left)
                part = part_of(keys[own], parts)
                sort = np.lexsort((rights.view(f"S{length}").ravel(), part))
                own, part = own[sort], part[sort]
                rights, lefts, right_sizes, left_sizes = rights[sort], lefts[sort], right_sizes[sort], left_sizes[sort]
                cuts = np.flatnonzero(np.diff(part)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(part)]):
                    shared, rest = front_code(rights[a:b])
                    sizes = np.concatenate([right_sizes[a:b], left_sizes[a:b]]).astype("<u2").tobytes()
                    body = zlib.compress(shared.tobytes() + sizes + lefts[a:b].tobytes() + rest, 1)
                    rows.append(_packed(int(part[a]), ids, marks, text[own[a:b]], place[own[a:b]], body))
                yield _suffix_batch(rows)

    return work


def _removed(prefixes: np.ndarray, rights: np.ndarray, lefts: np.ndarray, left_sizes: np.ndarray, rank: np.ndarray, length: int):
    """For suffixes in merged order, the least and the most bytes on the left of a string that also
    starts earlier; -1 where there is none.  ``rank`` is the order of id and place."""
    n, left = lefts.shape
    least, most = np.full(n, -1), np.full(n, -1)
    tail = np.zeros(n, U64)  # hash of the last d bytes on the left
    for d in range(left + 1):
        if d:
            tail = tail + mix(lefts[:, left - d].astype(U64) + U64(1) + (U64(d) << U64(16)))
        valid = np.flatnonzero((left_sizes >= d) & (rights >= length - d))
        if len(valid) < 2:
            continue
        interval = np.cumsum(prefixes < length - d)
        key = mix(interval[valid].astype(U64)) ^ mix(tail[valid])
        order = np.lexsort((rank[valid], key))
        sorted_key = key[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        ranks = rank[valid][order]
        first = ranks[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = valid[order[ranks > first]]
        most[later] = d
        least[later[least[later] < 0]] = d
    return least, most


def _merged(length: int):
    base = anchor_size(length)
    left = length - base

    def spans_of(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = [r for b in held for r in b.to_pylist()]
        ids, hashes, places, sizes_right, sizes_left, lefts = [], [], [], [], [], []
        strings, shared_lists = [], []
        for row in rows:
            n = row["n"]
            text = widen(row["text"], n).astype(np.int64)
            ids.append(np.frombuffer(row["ids"], np.int64)[text])
            hashes.append(np.frombuffer(row["hashes"], np.int64)[text])
            places.append(widen(row["place"], n).astype(np.int64))
            if row["part"] < 0:
                sizes_right.append(widen(row["strings"], n).astype(np.int64))
                continue
            body = zlib.decompress(row["strings"])
            shared = np.frombuffer(body, np.uint8, n)
            sizes = np.frombuffer(body, "<u2", 2 * n, n).astype(np.int64)
            sizes_right.append(sizes[:n])
            sizes_left.append(sizes[n:])
            lefts.append(np.frombuffer(body, np.uint8, n * left, 5 * n).reshape(n, left))
            strings.append(front_decode(shared, body[5 * n + n * left :], length))
            shared_lists.append(shared.tolist())
        id_, hash_, place = np.concatenate(ids), np.concatenate(hashes), np.concatenate(places)
        if rows[0]["part"] < 0:
            return span_lists(id_, hash_, place, np.concatenate(sizes_right))
        order, prefixes = merge_runs(strings, shared_lists)
        run = np.array(order)
        # the n-th time a run wins it gives its n-th string, and runs stand one after the other
        index = np.empty(len(run), np.int64)
        index[np.argsort(run, kind="stable")] = np.arange(len(run))
        prefixes = np.array(prefixes)
        prefixes[0] = 0
        rank = np.empty(len(id_), np.int64)
        by_place = np.lexsort((place, hash_, id_))
        same = np.zeros(len(id_), bool)
        same[1:] = (np.diff(id_[by_place]) == 0) & (np.diff(hash_[by_place]) == 0) & (np.diff(place[by_place]) == 0)
        rank[by_place] = np.cumsum(~same)
        id_, hash_, place, rank = id_[index], hash_[index], place[index], rank[index]
        rights = np.concatenate(sizes_right)[index]
        left_sizes = np.concatenate(sizes_left)[index]
        left_bytes = np.concatenate(lefts)[index]
        # suffixes that share no anchor with a neighbour hold no repeated string
        group = np.cumsum(prefixes < base)
        shares = np.bincount(group)[group] > 1
        pick = np.flatnonzero(shares)
        if not len(pick):
            return None
        own = prefixes[pick].copy()
        least, most = _removed(own, rights[pick], left_bytes[pick], left_sizes[pick], rank[pick], length)
        hit = most >= 0
        if not hit.any():
            return None
        at = place[pick][hit]
        return span_lists(id_[pick][hit], hash_[pick][hit], at - most[hit], at - least[hit] + length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_part(batches):
            out = spans_of(held)
            if out is not None:
                yield out

    return work


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, hash, text) to (id, hash, starts, ends): byte spans that repeat an earlier string."""
    base = anchor_size(length)
    longer = (base + length + 1) // 2
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(2 * total // max(1, length - base))
    found = materialize(repeated_anchors(texts, _byte_codes, base, longer, length, parts, CHUNK_BYTES), name="anchors")
    kept = found.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = parts_for(kept, SUFFIXES_PER_PART)
    candidates = texts.join(found, TEXT_KEYS).select(*TEXT_KEYS, "text", "places")
    placed = candidates.mapInArrow(_sorted_runs(length, parts), SUFFIX_SCHEMA)
    placed = placed.repartition(-(-parts // PARTS_PER_TASK), "part").sortWithinPartitions("part")
    spans = placed.mapInArrow(_merged(length), SPAN_SCHEMA)
    return spans.groupBy(*TEXT_KEYS).agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )


def cut_spans(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """(kept bytes, n_bytes, n_removed, n_spans) of each text without its spans."""
    kept, n_bytes, n_removed, n_spans = [], [], [], []
    low, counts = flat_lists(starts)
    high, _ = flat_lists(ends)
    before = np.concatenate([[0], np.cumsum(counts)])
    for chunk in chunks(texts, CHUNK_BYTES):
        text = np.repeat(np.arange(chunk.texts), counts[chunk.first : chunk.first + chunk.texts])
        own = slice(before[chunk.first], before[chunk.first + chunk.texts])
        # one more place per text, so that spans of neighbours do not touch
        shift = chunk.offsets[text] + text
        cover = np.zeros(len(chunk.data) + chunk.texts + 1, np.int32)
        np.add.at(cover, low[own] + shift, 1)
        np.subtract.at(cover, high[own] + shift, 1)
        inside = np.cumsum(cover[:-1]) > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        bounds = chunk.offsets + np.arange(chunk.texts + 1)
        spans = np.diff(np.concatenate([[0], np.cumsum(begins)])[bounds])
        gap = np.zeros(len(inside), bool)
        gap[bounds[1:] - 1] = True
        stays = ~inside[~gap]
        left = np.concatenate([[0], np.cumsum(stays)])[chunk.offsets]
        body = chunk.data[stays].tobytes()
        kept += [body[a:b] for a, b in zip(left, left[1:])]
        sizes = np.diff(chunk.offsets)
        n_bytes.append(sizes)
        n_removed.append(sizes - np.diff(left))
        n_spans.append(spans)
    columns = [np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (n_bytes, n_removed, n_spans)]
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *map(pa.array, columns)], ["kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and one struct, the last column: kept (bytes), n_bytes, n_removed, n_spans."""
    require(docs, [id_col, text_col])
    (name,) = fresh(docs, "suffix")
    texts = keyed_texts(docs, id_col, text_col)
    keys = dict(zip(("id", "hash", "starts", "ends"), fresh(docs, "suffix_id", "suffix_hash", "suffix_starts", "suffix_ends")))
    spans = repeated_spans(texts, length).withColumnsRenamed(keys)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns(
        {keys["id"]: F.coalesce(column(id_col).cast("long"), F.lit(LAST_ID)), keys["hash"]: F.xxhash64(text)}
    )
    joined = keyed.join(spans, [keys["id"], keys["hash"]], "left")
    cut = F.arrow_udf(cut_spans, "kept binary, n_bytes long, n_removed long, n_spans long")
    result = joined.withColumn(name, cut(text, F.col(keys["starts"]), F.col(keys["ends"])))
    return result.select(*[column(c) for c in docs.columns], name)


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept bytes as text; characters that a cut splits are left out, null texts stay."""

    def decode(kept: pa.Array) -> pa.Array:
        return pa.array([k.as_py().decode(errors="ignore") for k in kept], pa.string())

    cut = remove_repeated_bytes(docs, length, id_col, text_col)
    name = cut.columns[-1]
    text = F.when(column(text_col).isNotNull(), F.arrow_udf(decode, "string")(F.col(f"{name}.kept")))
    return cut.withColumn(text_col, text).select(*[column(c) for c in docs.columns])
