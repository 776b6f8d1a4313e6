"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Documents longer than a sequence are cut into full pieces and one shorter first piece.  Lengths
are whole numbers up to the sequence length, so the packing is decided on the histogram of piece
lengths, which has at most ``seq_len`` rows whatever the corpus: a sequence is filled greedily with
the longest pieces that fit; if a gap is left, its smallest piece is exchanged for the two unpacked
pieces that fill the expanded gap most tightly.  The pattern found is used as often as the counts
allow, so there are at most about as many patterns as lengths.  Pieces of one length then get their
place by rank: ranks are counted per written part, and no task sees all pieces of a length.

Null and empty texts are one piece that holds the end token alone.  Repeated rows are packed as
often as they occur.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .frames import column, require, small_batches
from .texts import chunks
from .tokens import load_encoder

SEQ_LEN = 2048
END_TOKEN = 0


@dataclass
class Pattern:
    """``bins`` sequences, each with these piece lengths in this order."""

    bins: int
    lengths: list[int]


def _largest(counts: np.ndarray, most: int) -> int:
    """The largest available length of at most ``most``, 0 if there is none."""
    found = np.flatnonzero(counts[: max(most, 0) + 1])
    return int(found[-1]) if len(found) else 0


def _two_tighter(counts: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two available lengths whose sum is nearest to ``room`` and above ``least``."""
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, "right") - 1
    valid = at >= 0
    first, second = have[valid], have[at[valid]]
    # a pair of equal lengths needs two pieces; the next smaller partner stands in otherwise
    single = (first == second) & (counts[first] < 2)
    second = np.where(single, have[np.maximum(at[valid] - 1, 0)], second)
    usable = (first != second) | (counts[first] >= 2)
    sums = np.where(usable, first + second, 0)
    best = int(sums.argmax()) if len(sums) else -1
    if best < 0 or sums[best] <= least or sums[best] > room:
        return None
    return int(max(first[best], second[best])), int(min(first[best], second[best]))


def best_two_fit(histogram: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that together use every piece: ``histogram[n]`` pieces of length n."""
    counts = histogram.astype(np.int64).copy()
    counts[0] = 0
    patterns = []
    while counts.any():
        left, rest = counts.copy(), capacity
        lengths: list[int] = []
        while size := _largest(left, rest):
            fits = min(int(left[size]), rest // size)
            lengths += [size] * fits
            left[size] -= fits
            rest -= size * fits
        if rest and len(lengths) > 1:
            smallest = lengths[-1]
            pair = _two_tighter(left, rest + smallest, smallest)
            if pair:
                left[smallest] += 1
                lengths[-1:] = pair
                left[pair[0]] -= 1
                left[pair[1]] -= 1
        sizes, used = np.unique(lengths, return_counts=True)
        bins = int((counts[sizes] // used).min())
        counts[sizes] -= bins * used
        patterns.append(Pattern(bins, lengths))
    return patterns


def piece_table(
    docs: DataFrame, tokenizer: str, seq_len: int, id_col: str, text_col: str, end_token: int, keep_ids: bool
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids], and its part and rank in it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer)
        end = np.uint32(end_token).astype("<u4").tobytes()
        seen = [0] * (seq_len + 1)
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0)
            for chunk in chunks(batch.column(1)):
                ids, bounds = encoder.encode_chunk(chunk)
                raw = ids.astype("<u4", copy=False).tobytes()
                for i in range(chunk.texts):
                    own = raw[4 * bounds[i] : 4 * bounds[i + 1]] + end
                    tokens = len(own) // 4
                    begin = 0
                    for piece, stop in enumerate(range((tokens - 1) % seq_len + 1, tokens + 1, seq_len)):
                        cut_ids = own[4 * begin : 4 * stop]
                        size = stop - begin
                        rows.append((chunk.first + i, piece, begin, size, zlib.crc32(cut_ids), seen[size], cut_ids if keep_ids else b""))
                        seen[size] += 1
                        begin = stop
            if not rows:
                continue
            at, piece, start, length, crc, rank, ids = zip(*rows)
            arrays = [
                pc.take(keys, pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(rank, pa.int64()),
                pa.array([part] * len(rows), pa.int32()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_part"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    schema = (
        T.StructType([rows.schema["doc_id"]]).add("piece", "integer").add("start", "long").add("length", "long")
        .add("ids_crc32", "long").add("_rank", "long").add("_part", "integer")
    )
    if keep_ids:
        schema = schema.add("ids", "binary")
    return rows.mapInArrow(cut, schema)


def _slots(patterns: list[Pattern], histogram: np.ndarray) -> pa.Table:
    """One row per pattern and length: which ranks of the length it takes and where they go."""
    rows = []
    taken = np.zeros(len(histogram), np.int64)
    sequence = 0
    for pattern in patterns:
        ends = np.cumsum(pattern.lengths)
        for length in dict.fromkeys(pattern.lengths):
            at = [i for i, n in enumerate(pattern.lengths) if n == length]
            first = int(ends[at[0]]) - length
            rows.append((length, int(taken[length]), int(taken[length]) + len(at) * pattern.bins, len(at), sequence, first))
            taken[length] += len(at) * pattern.bins
        sequence += pattern.bins
    names = ["length", "_from", "_to", "_per_bin", "_sequence", "_offset"]
    return pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    seq_len: int = SEQ_LEN,
    end_token: int = END_TOKEN,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    planner: Callable[[np.ndarray, int], list[Pattern]] = best_two_fit,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` also the
    piece's ids as little-endian unsigned 32-bit numbers.

    The pieces are written once as a stage table: a rank refers to the part that was written, not
    to one that a lost executor makes anew.
    """
    require(docs, [id_col, text_col])
    spark = docs.sparkSession
    small_batches(spark)
    pieces = materialize(piece_table(docs, tokenizer, seq_len, id_col, text_col, end_token, keep_ids), name="pieces")
    parts = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counted = parts.groupBy("length").agg(F.sum("_n").alias("_n")).toArrow()  # at most seq_len rows
    histogram = np.zeros(seq_len + 1, np.int64)
    histogram[counted["length"].to_numpy()] = counted["_n"].to_numpy()
    slots = spark.createDataFrame(
        _slots(planner(histogram, seq_len), histogram),
        "length long, _from long, _to long, _per_bin long, _sequence long, _offset long",
    )
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    slot_lists = slots.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("_to", "_from", "_per_bin", "_sequence", "_offset"))).alias("_slots")
    )
    ranked = (
        pieces.join(bases, ["length", "_part"])
        .withColumn("_rank", F.col("_rank") + F.col("_base"))
        .join(F.broadcast(slot_lists), "length")  # at most seq_len rows, from seq_len patterns or so
        .withColumn("_slot", F.expr("element_at(filter(_slots, s -> s._to > _rank), 1)"))
    )
    inside = F.col("_rank") - F.col("_slot._from")
    return ranked.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_slot._sequence") + F.floor(inside / F.col("_slot._per_bin"))).alias("sequence_id"),
        (F.col("_slot._offset") + inside % F.col("_slot._per_bin") * F.col("length")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )
