"""Token ids of whole texts with a public tokenizer file.

The byte-level pre-tokenizer never joins white space with what precedes it, so a text may be cut
before the first white space character of each run.  The parts repeat a lot: they are told apart by
64-bit hashes, and each distinct part of a chunk is encoded once.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from .texts import Chunk, runs

CACHED_PARTS = 250_000
# last and first bytes of the white space characters beyond ASCII; a part is not cut behind them
_WIDE_SPACE_ENDS = np.zeros(256, bool)
_WIDE_SPACE_ENDS[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE_SPACE_LEADS = np.zeros(256, bool)
_WIDE_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a printable Latin-1 character stands
    for its own byte, the others are numbered from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, if ids grow in the order of the merges; else None."""
    vocabulary = spec["model"]["vocab"]
    merged = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    ids = [vocabulary.get(m.replace(" ", "", 1)) for m in merged]
    if spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or None in ids:
        return None
    if any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    alphabet = _byte_alphabet()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}


def part_starts(chunk: Chunk) -> np.ndarray:
    """Where the parts of all texts of the chunk begin."""
    data, space = chunk.data, chunk.is_space
    # 0x1C-0x1F are white space to the tokenizer, but not to ``is_space``
    any_space = space | ((data >= 0x1C) & (data <= 0x1F))
    starts = space.copy()
    starts[1:] &= ~any_space[:-1]
    wide = _WIDE_SPACE_ENDS[data]
    lead = np.zeros(len(data), bool)
    lead[1:] |= _WIDE_SPACE_LEADS[data[:-1]]
    lead[2:] |= _WIDE_SPACE_LEADS[data[:-2]]
    starts[1:] &= ~(wide & lead)[:-1]
    filled = chunk.offsets[:-1][np.diff(chunk.offsets) > 0]
    starts[filled] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of the texts of a chunk as the tokenizer file gives them, none added before or after a text.

    A string that the file lists as an added token, such as ``<|endoftext|>``, is one id where a text
    holds it, as for the tokenizer itself; texts are cut there first.  Remembers the ids of at most
    ``CACHED_PARTS`` parts, as arrays sorted by the hash of the part.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ranks = _ranks(spec)
        self.ranked = self.tokenizer = None
        if ranks:
            self.ranked = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.token_bytes[list(ranks.values())] = [len(t) for t in ranks]
        else:
            self.tokenizer = Tokenizer.from_file(path)
        self.added = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])} if ranks else {}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.added_pattern = re.compile(b"|".join(map(re.escape, longest_first))) if self.added else None
        self.keys = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, text: bytes) -> np.ndarray:
        if self.ranked:
            return np.array(self.ranked.encode_ordinary(text.decode()), np.uint32)
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _encode_joined(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for parts that may follow each other in one text."""
        joined = data[runs(starts, sizes)].tobytes()
        ids = self.encode(joined)
        stops = np.cumsum(self.token_bytes[ids])
        ends = np.searchsorted(stops, np.cumsum(sizes), "left") + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, chunk: Chunk, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Adds the ids of the given new parts to the arrays."""
        joinable = chunk.is_space[starts] & ~np.isin(ends, chunk.offsets)
        if not self.ranked:
            joinable[:] = False
        order = np.argsort(~joinable, kind="stable")
        keys, starts, ends = keys[order], starts[order], ends[order]
        n = int(joinable.sum())
        pools, sizes = [self.pool], [np.zeros(0, np.int64)]
        if n:
            ids, counts = self._encode_joined(chunk.data, starts[:n], ends[:n] - starts[:n])
            pools.append(ids)
            sizes.append(counts)
        alone = [self.encode(chunk.data[a:b].tobytes()) for a, b in zip(starts[n:], ends[n:])]
        pools += alone
        sizes.append(np.fromiter(map(len, alone), np.int64, len(alone)))
        sizes = np.concatenate(sizes)
        begins = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate(pools)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.begins = np.concatenate([self.begins, begins])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]

    def encode_chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin: texts + 1 numbers."""
        found = [] if self.added_pattern is None else [m.span() for m in self.added_pattern.finditer(chunk.data.tobytes())]
        if found:
            text = np.searchsorted(chunk.offsets, np.array(found) - [[0, 1]], "right")
            found = [span for span, (a, b) in zip(found, text.tolist()) if a == b]  # not across two texts
        if not found:
            return self._encode_parts(chunk)
        pieces = np.sort(np.concatenate([chunk.offsets, np.array(found).ravel()]))
        ids, bounds = self._encode_parts(Chunk(chunk.first, chunk.data, pieces))
        counts, own = np.diff(bounds), np.split(ids, bounds[1:-1])
        for begin, end in found:
            piece = int(np.searchsorted(pieces, begin, "right")) - 1
            own[piece] = np.array([self.added[chunk.data[begin:end].tobytes()]], np.uint32)
            counts[piece] = 1
        total = np.concatenate([[0], np.cumsum(counts)])
        return np.concatenate(own), total[np.searchsorted(pieces, chunk.offsets)]

    def _encode_parts(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        starts = part_starts(chunk)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(chunk.texts + 1, np.int64)
        ends = np.append(starts[1:], len(chunk.data))
        keys, first, inverse = np.unique(chunk.byte_hash.spans(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_PARTS:
            self.keys, self.begins, self.sizes = self.keys[:0], self.begins[:0], self.sizes[:0]
            self.pool = self.pool[:0]
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            self._learn(chunk, keys[new], starts[first[new]], ends[first[new]])
        at = np.searchsorted(self.keys, keys)
        begins, counts = self.begins[at], self.sizes[at][inverse]
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, chunk.offsets)]
        return self.pool[runs(begins[inverse], counts)], bounds


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)
