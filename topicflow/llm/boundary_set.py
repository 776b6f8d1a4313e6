"""A Roaring-style set of the places where a text may be cut, with rank select.

Positions are split by their upper bits into containers of 65 536 positions.  A container takes the
smallest of three forms: a sorted array, a bitmap, or runs of neighbours.  Cardinalities are summed up
over the containers, so ``select`` finds the container of a rank by binary search and the position by
a select inside it, without going over the positions before.  Sets are stored as bytes, so that a
table of them serves many draws of cuts.
"""

from __future__ import annotations

import struct

import numpy as np

WIDTH = 1 << 16
ARRAY, BITMAP, RUN = range(3)
_HEAD = struct.Struct("<IBII")  # upper bits, form, cardinality, bytes of the payload


class ArrayContainer:
    form = ARRAY

    def __init__(self, lows: np.ndarray):
        self.lows = lows.astype("<u2")

    def select(self, rank: int) -> int:
        return int(self.lows[rank])

    def to_bytes(self) -> bytes:
        return self.lows.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> ArrayContainer:
        return cls(np.frombuffer(raw, "<u2"))


class BitmapContainer:
    form = BITMAP

    def __init__(self, lows: np.ndarray):
        bits = np.zeros(WIDTH, np.uint8)
        bits[lows] = 1
        self._take(np.packbits(bits, bitorder="little").view("<u8"))

    def _take(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.cumsum(np.bitwise_count(words)) - np.bitwise_count(words)

    def select(self, rank: int) -> int:
        # the last word with at most ``rank`` members before it, empty words after it passed over
        word = int(np.searchsorted(self.before, rank, "right")) - 1
        bits = np.unpackbits(self.words[word : word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[rank - int(self.before[word])])

    def to_bytes(self) -> bytes:
        return self.words.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BitmapContainer:
        own = cls.__new__(cls)
        own._take(np.frombuffer(raw, "<u8"))
        return own


class RunContainer:
    form = RUN

    def __init__(self, lows: np.ndarray):
        first = np.flatnonzero(np.diff(lows, prepend=lows[0] - 2) != 1)
        self._take(lows[first], np.diff(first, append=len(lows)) - 1)

    def _take(self, starts: np.ndarray, more: np.ndarray) -> None:
        self.starts, self.more = starts.astype("<u2"), more.astype("<u2")  # a run has 1 + more members
        counts = self.more.astype(np.int64) + 1
        self.before = np.cumsum(counts) - counts

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.starts[run]) + rank - int(self.before[run])

    def to_bytes(self) -> bytes:
        return np.stack([self.starts, self.more], axis=1).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> RunContainer:
        pairs = np.frombuffer(raw, "<u2").reshape(-1, 2)
        own = cls.__new__(cls)
        own._take(pairs[:, 0], pairs[:, 1])
        return own


_FORMS = {c.form: c for c in (ArrayContainer, BitmapContainer, RunContainer)}


def container(lows: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted distinct positions below ``WIDTH``."""
    runs = 1 + int(np.count_nonzero(np.diff(lows) != 1))
    sizes = {ArrayContainer: 2 * len(lows), BitmapContainer: WIDTH // 8, RunContainer: 4 * runs}
    return min(sizes, key=sizes.get)(lows)


class BoundarySet:
    def __init__(self, keys: np.ndarray, counts: np.ndarray, containers: list):
        self.keys, self.containers = keys, containers
        self.counts = counts
        self.upto = np.cumsum(counts)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    @classmethod
    def of(cls, positions: np.ndarray) -> BoundarySet:
        """From sorted distinct positions."""
        if not len(positions):
            return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        high, low = positions >> 16, positions & (WIDTH - 1)
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = np.split(low, cuts) if len(cuts) else [low]
        keys = high[np.concatenate([[0], cuts])]
        return cls(keys, np.array([len(p) for p in parts], np.int64), [container(p) for p in parts])

    def select(self, rank: int) -> int:
        """The member that ``rank`` others precede."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.upto, rank, "right"))
        inside = rank - int(self.upto[at] - self.counts[at])
        return (int(self.keys[at]) << 16) + self.containers[at].select(inside)

    def to_bytes(self) -> bytes:
        out = []
        for key, count, own in zip(self.keys.tolist(), self.counts.tolist(), self.containers):
            raw = own.to_bytes()
            out += [_HEAD.pack(key, own.form, count, len(raw)), raw]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> BoundarySet:
        keys, counts, containers, at = [], [], [], 0
        while at < len(raw):
            key, form, count, size = _HEAD.unpack_from(raw, at)
            at += _HEAD.size
            keys.append(key)
            counts.append(count)
            containers.append(_FORMS[form].from_bytes(raw[at : at + size]))
            at += size
        return cls(np.array(keys, np.int64), np.array(counts, np.int64), containers)
