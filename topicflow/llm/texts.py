"""Words, lines and hashes of whole texts as NumPy arrays over the UTF-8 bytes of an Arrow column.

A chunk holds the bytes of consecutive texts of one Arrow batch, at most ``CHUNK_BYTES`` of them
unless a single text is longer.  Nothing is decoded; white space is ``[\\x20\\x09-\\x0D]``, so the
words are those of the pattern ``[^\\x20\\x09-\\x0D]+`` on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, 256, dtype=U64, endpoint=False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the bits of 64-bit keys."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand.

    Tables for a longer text than a few chunks are made for it and not kept.
    """

    KEPT = 4 * CHUNK_BYTES

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 2**64))
        self.tables = [np.ones(1, U64), np.ones(1, U64)]

    def get(self, n: int, inverse: bool = False) -> np.ndarray:
        if len(self.tables[inverse]) >= n:
            return self.tables[inverse][:n]
        steps = np.full(-(-n >> 16) << 16, self.bases[inverse], U64)
        steps[0] = 1
        table = np.multiply.accumulate(steps)
        if n <= self.KEPT:
            self.tables[inverse] = table
        return table[:n]


_POWERS = _Powers(_MULTIPLIER)


class RollingHash:
    """64-bit hashes of any spans of a sequence of codes, in constant time per span."""

    def __init__(self, codes: np.ndarray):
        self.prefix = np.zeros(len(codes) + 1, U64)
        np.cumsum(codes * _POWERS.get(len(codes)), out=self.prefix[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _POWERS.get(len(self.prefix), inverse=True)
        return mix((self.prefix[ends] - self.prefix[starts]) * back[starts])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` codes, by start."""
        n = len(self.prefix) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.prefix[size:] - self.prefix[:n]) * _POWERS.get(len(self.prefix), inverse=True)[:n])


@dataclass
class Chunk:
    """``data`` holds the bytes of the texts ``first .. first + len(offsets) - 1`` of a batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> Chunk:
        """The same texts with A-Z in lower case."""
        return Chunk(self.first, _LOWER[self.data], self.offsets)

    @cached_property
    def is_space(self) -> np.ndarray:
        return _SPACE[self.data]

    @cached_property
    def byte_hash(self) -> RollingHash:
        return RollingHash(_BYTE_CODE[self.data])

    @cached_property
    def _word_spans(self) -> tuple[np.ndarray, np.ndarray]:
        solid = ~self.is_space
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= self.is_space[:-1]
        stops[:-1] &= self.is_space[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(solid))]
        begins[edges] = solid[edges]
        stops[edges - 1] = solid[edges - 1]
        return np.flatnonzero(begins), np.flatnonzero(stops) + 1

    @property
    def word_starts(self) -> np.ndarray:
        return self._word_spans[0]

    @property
    def word_ends(self) -> np.ndarray:
        return self._word_spans[1]

    @cached_property
    def word_hashes(self) -> np.ndarray:
        return self.byte_hash.spans(self.word_starts, self.word_ends)

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Number of words before each text, and in all: texts + 1 numbers."""
        return np.searchsorted(self.word_starts, self.offsets)

    def window_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, hash) of the windows of ``size`` words that lie in one text."""
        bounds, hashes = self.word_bounds, RollingHash(self.word_hashes).windows(size)
        counts = np.maximum(np.diff(bounds) - size + 1, 0)
        starts = runs(bounds[:-1], counts)
        return starts, hashes[starts]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a flag per byte over each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, count), one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column, nulls as empty ones, in chunks of bounded size."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    raw = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(raw, raw[begin] + max_bytes, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield Chunk(begin, data[raw[begin] : raw[end]], raw[begin : end + 1] - raw[begin])
        begin = end
    give_back()


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library than glibc
    _TRIM = None


def give_back() -> None:
    """Returns what Arrow and NumPy have freed to the system: an executor's memory is shared by its
    workers, and an idle worker would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def concat_columns(parts: list[dict[str, np.ndarray]], fields: list[pa.Field]) -> pa.StructArray:
    """One struct array from per-chunk dictionaries of columns."""
    arrays = [
        pa.concat_arrays([pa.array(p[f.name], type=f.type) for p in parts]) if parts else pa.array([], type=f.type)
        for f in fields
    ]
    return pa.StructArray.from_arrays(arrays, fields=fields)
