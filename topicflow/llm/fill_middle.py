"""Fill-in-the-middle: a text is cut twice and its middle moved to the end.

The places where a text may be cut are a ``BoundarySet``: 0 and the end of every unit, as code points.
Two draws from a hash of seed and id pick two ranks; ``select`` gives both offsets.  Whether a text
is changed at all, and the order of its parts, are drawn from the same hash, so reruns agree and no
row depends on another: nothing is shuffled.

Null texts count as empty.  Empty texts, and texts that hold one of the markers themselves, stay plain,
so every output can be undone (``restored``).  A null id is drawn from the seed alone; rows that repeat
an id repeat its draws.  An empty table gives an empty result; other columns pass through, and the new
ones take a free name if theirs is taken.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boundary_set import BoundarySet
from .frames import column, fresh, require, small_batches
from .texts import Chunk, chunks

SEED = 42
RATE_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("word", "line", "char")

FIELDS = [
    pa.field("n", pa.int64()),
    pa.field("form", pa.string()),
    pa.field("prefix_chars", pa.int64()),
    pa.field("middle_chars", pa.int64()),
    pa.field("output", pa.string()),
]
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def _unit_ends(chunk: Chunk, unit: str) -> np.ndarray:
    """Byte offsets in the chunk where units end, ascending; the end of each filled text is one."""
    filled = np.diff(chunk.offsets) > 0
    text_ends = chunk.offsets[1:][filled]
    if unit == "word":
        # white space belongs to the word after it; at the end of a text it is a unit of its own
        return np.union1d(chunk.word_ends, text_ends)
    if unit == "line":
        return np.union1d(np.flatnonzero(chunk.data == 0x0A) + 1, text_ends)
    lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    return np.union1d(lead[lead > 0], text_ends)


def chunk_boundaries(chunk: Chunk, unit: str) -> Iterator[BoundarySet]:
    """One set per text, in code points."""
    chars = np.zeros(len(chunk.data) + 1, np.int32)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=chars[1:])
    ends = _unit_ends(chunk, unit)
    places = chars[ends]
    # an end at a text's first byte is the last text's, not its own
    first = np.searchsorted(ends, chunk.offsets[:-1], "right")
    last = np.searchsorted(ends, chunk.offsets[1:], "right")
    for begin, a, b in zip(chars[chunk.offsets[:-1]].tolist(), first.tolist(), last.tolist()):
        own = np.zeros(1 + max(b - a, 0), np.int64)
        own[1:] = places[a:b] - begin
        yield BoundarySet.of(own)


def boundary_sets(texts: pa.Array, unit: str) -> pa.Array:
    return pa.array([s.to_bytes() for chunk in chunks(texts) for s in chunk_boundaries(chunk, unit)], pa.binary())


def draws(seed: int, key: str | None) -> tuple[int, int, int, int]:
    """The first four 32-bit numbers of the sha256 of ``seed:key``."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{key or ''}".encode()).digest()[:16])


def cut_text(text: str, places: BoundarySet, numbers: tuple[int, int, int, int], rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output)."""
    n = len(places) - 1
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places.select(low), places.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def with_boundaries(docs: DataFrame, unit: str = "word", text_col: str = "text") -> DataFrame:
    """Adds ``boundaries``, the stored set of each text, as the last column."""
    require(docs, [text_col])
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    small_batches(docs.sparkSession)
    (name,) = fresh(docs, "boundaries")
    return docs.withColumn(name, F.arrow_udf(lambda t: boundary_sets(t, unit), "binary")(column(text_col).cast("string")))


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    rate_percent: int = RATE_PERCENT,
    spm_percent: int = SPM_PERCENT,
    unit: str = "word",
    id_col: str = "doc_id",
    text_col: str = "text",
    boundaries_col: str | None = None,
) -> DataFrame:
    """All columns of ``docs`` and the struct ``fim``, the last column: n units, form (plain, psm or
    spm), prefix_chars and middle_chars (null if plain) and the output text.

    With ``boundaries_col``, sets stored by ``with_boundaries`` are used: further epochs, with other
    seeds, don't look for the units again.
    """
    require(docs, [id_col, text_col])
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    small_batches(docs.sparkSession)

    def rows(keys: pa.Array, texts: pa.Array, stored: pa.Array | None) -> Iterator[tuple]:
        for chunk in chunks(texts):
            if stored is None:
                sets = chunk_boundaries(chunk, unit)
            else:
                sets = map(BoundarySet.from_bytes, stored.slice(chunk.first, chunk.texts).to_pylist())
            names = keys.slice(chunk.first, chunk.texts).to_pylist()
            for i, (key, places) in enumerate(zip(names, sets)):
                yield cut_text(chunk.text(i).decode(), places, draws(seed, key), rate_percent, spm_percent)

    def work(keys: pa.Array, texts: pa.Array, stored: pa.Array | None = None) -> pa.Array:
        columns = list(zip(*rows(keys, texts, stored))) or [()] * len(FIELDS)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], fields=FIELDS)

    (name,) = fresh(docs, "fim")
    given = [column(id_col).cast("string"), column(text_col).cast("string")]
    if boundaries_col:
        require(docs, [boundaries_col])
        return docs.withColumn(name, F.arrow_udf(lambda k, t, s: work(k, t, s), SCHEMA)(*given, column(boundaries_col)))
    return docs.withColumn(name, F.arrow_udf(lambda k, t: work(k, t), SCHEMA)(*given))


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from an output and its form; the markers occur once each, unless plain."""

    def after(x: Column, head: Column) -> Column:
        return F.substr(x, F.length(head) + F.lit(len(MIDDLE) + 1))

    body = F.substr(output, F.lit(len(PREFIX) + 1))
    one = F.split_part(body, F.when(form == "psm", SUFFIX).otherwise(PREFIX), F.lit(1))
    rest = after(body, one)
    other = F.split_part(rest, F.lit(MIDDLE), F.lit(1))
    middle = after(rest, other)
    whole = F.when(form == "psm", F.concat(one, middle, other)).otherwise(F.concat(other, middle, one))
    return F.when(form == "plain", output).otherwise(whole)
