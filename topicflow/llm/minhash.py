"""MinHash near-duplicates with min-max signatures.

A document is its set of word shingles.  Each permutation of the hashed shingles gives two signature
values, its minimum and its maximum, so half the hash evaluations make as many values; both agree
between two sets with a probability equal to their Jaccard similarity.  Bands of values place sets
in buckets.

Equal sets are one node from the start.  Each bucket's members are first compared with a few of
them, its hubs, on their full sets.  Sets that are then still outside the bucket's most frequent
component are compared with all its members, inside tasks that hold a tile of them at a time and
send on links only.  So no bucket of near copies is expanded into its pairs, and no candidate is
dropped.  Components of links between equal or near sets get the smallest id.

Documents without a word or a text have no shingles and link with nothing.  Rows that repeat an id
stand for themselves in the comparison and share the id's component; a null id is never smallest,
so such a row is kept only if no other row shares its component.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .components import components
from .frames import column, fresh, require, small_batches
from .texts import U64, Chunk, RollingHash, chunks, mix, runs

SHINGLE = 3
PERCENT = 85
ROWS = 5
HUBS = 3
TILE_SETS = 512
BANDS = 20  # a pair at the limit of 85 % shares no band with a probability of about 8e-6

_CODES = np.random.Generator(np.random.PCG64(23)).integers(0, 2**64, (2, 512), dtype=U64, endpoint=False)


def shingles(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin.

    A text with fewer than ``size`` words, but some, has its whole sequence as its one shingle.
    """
    lowered = chunk.lowered()
    starts, hashes = lowered.window_hashes(size)
    bounds = lowered.word_bounds
    owner = np.searchsorted(bounds, starts, "right") - 1
    words = np.diff(bounds)
    short = np.flatnonzero((words > 0) & (words < size))
    if len(short):
        whole = RollingHash(lowered.word_hashes).spans(bounds[short], bounds[short + 1])
        owner = np.concatenate([owner, short])
        hashes = np.concatenate([hashes, mix(whole ^ U64(0x5EED))])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(hashes):
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        owner, hashes = owner[first], hashes[first]
    return hashes, np.searchsorted(owner, np.arange(chunk.texts + 1))


def band_keys(hashes: np.ndarray, at: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One key per band for each set that begins at ``at``; bands of minima, then of maxima."""
    permutations = rows * -(-bands // 2)
    keys = np.zeros((bands, len(at)), U64)
    for p in range(permutations):
        values = hashes ^ _CODES[0, p]
        values *= _CODES[1, p] | U64(1)
        band = p // rows
        for low, reduce in ((True, np.minimum), (False, np.maximum)):
            target = band if low else band + -(-bands // 2)
            if target < bands:
                keys[target] = mix(keys[target] + reduce.reduceat(values, at))
    return keys + np.arange(bands, dtype=U64)[:, None] * U64(0x9E3779B97F4A7C15)


def set_ids(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128-bit digests of the sets that begin at ``at``."""
    sums = [np.add.reduceat(mix(hashes ^ _CODES[i, -1]), at) for i in (0, 1)]
    return [a.tobytes() + b.tobytes() for a, b in zip(*(mix(s) for s in sums))]


def sketch(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """(id, text) to (id, n_shingles, set_id, bands); the last two are null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                hashes, bounds = shingles(chunk, size)
                counts = np.diff(bounds)
                filled = np.flatnonzero(counts)
                ids = [None] * chunk.texts
                keys = [None] * chunk.texts
                if len(filled):
                    own = band_keys(hashes, bounds[filled], rows, bands).view(np.int64).T
                    for i, digest, key in zip(filled, set_ids(hashes, bounds[filled]), own):
                        ids[i], keys[i] = digest, key
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.texts),
                        pa.array(counts.astype(np.int64)),
                        pa.array(ids, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "set_id", "bands"],
                )

    schema = T.StructType([docs.schema["id"]]).add("n_shingles", "long").add("set_id", "binary").add("bands", T.ArrayType(T.LongType()))
    return docs.mapInArrow(work, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_id, hashes) of the wanted sets: (id, set_id), the id of a row that has the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                hashes, bounds = shingles(chunk, size)
                filled = np.flatnonzero(np.diff(bounds))
                ids = [None] * chunk.texts
                if len(filled):
                    for i, digest in zip(filled, set_ids(hashes, bounds[filled])):
                        ids[i] = digest
                sets = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.binary()), batch.column(1).slice(chunk.first, chunk.texts), pa.array(sets, pa.binary())],
                    ["own", "set_id", "hashes"],
                )

    rows = docs.join(wanted, "id").select("text", "set_id")
    found = rows.mapInArrow(work, "own binary, set_id binary, hashes binary")
    # several rows may carry the id, and several of them the set
    return found.where(F.col("own") == F.col("set_id")).groupBy("set_id").agg(F.any_value("hashes").alias("hashes"))


def _common(left: pa.Array, right: pa.Array) -> pa.Array:
    sizes = np.zeros(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left, right)):
        a, b = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        sizes[i] = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return pa.array(sizes)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) pairs of set ids with their sizes and the size of their intersection."""
    left = sets.select(F.col("set_id").alias("a"), F.col("hashes").alias("_left"))
    right = sets.select(F.col("set_id").alias("b"), F.col("hashes").alias("_right"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select(
            "a",
            "b",
            (F.octet_length("_left") / 8).cast("long").alias("size_a"),
            (F.octet_length("_right") / 8).cast("long").alias("size_b"),
            F.arrow_udf(_common, "long")("_left", "_right").alias("common"),
        )
    )


def _hubs(placed: DataFrame) -> DataFrame:
    """(bucket, hubs) of the buckets that hold several sets: ``HUBS`` members, some perhaps the same.

    The order is the same for all buckets, so those of one group of near copies mostly choose the same
    hubs, and a set meets a few hubs, not some others in each of its bands.
    """
    order = [F.struct(F.xxhash64("set_id", F.lit(i)).alias("h"), "set_id") for i in range(HUBS)]
    found = placed.groupBy("bucket").agg(F.count("*").alias("_n"), F.array(*[F.min(o) for o in order]).alias("hubs"))
    return found.where("_n > 1").select("bucket", F.col("hubs.set_id").alias("hubs"))


def _stray_rows(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, tile, visitor, set_id, root, stray, hashes) from members (bucket, set_id, root).

    Of each bucket that holds several roots, the sets outside its most frequent root are strays.
    They are dealt to tiles of about ``TILE_SETS``, and every member of the bucket visits each tile.
    """
    counts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("m"), (F.sum("n") - F.max("n")).alias("strays")
    )
    main = main.where("strays > 0").select(
        "bucket", F.col("m.root").alias("main"), F.ceil(F.col("strays") / TILE_SETS).cast("int").alias("tiles")
    )
    rows = members.join(main, "bucket").withColumn("stray", F.col("root") != F.col("main"))
    own = F.pmod(F.xxhash64("set_id"), F.col("tiles")).cast("int")
    visits = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(t.alias("tile"), F.lit(True).alias("visitor")))
    home = F.array(F.struct(own.alias("tile"), F.lit(False).alias("visitor")))
    places = F.when(F.col("stray"), F.concat(visits, home)).otherwise(visits)
    placed = rows.select("bucket", "set_id", "root", "stray", F.inline(places))
    return placed.join(sets, "set_id").select("bucket", "tile", "visitor", "set_id", "root", "stray", "hashes")


class _Strays:
    """The strays of one tile, indexed by shingle."""

    def __init__(self) -> None:
        self.ids: list[bytes] = []
        self.roots: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.seen: set[tuple[int, bytes]] = set()
        self.hashes: np.ndarray | None = None

    def index(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets])
        hashes = np.concatenate(self.sets)
        order = np.argsort(hashes, kind="stable")
        self.owners = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.hashes, self.starts, self.counts = np.unique(hashes[order], return_index=True, return_counts=True)

    def near(self, own: np.ndarray, percent: int) -> np.ndarray:
        """The strays that are near the set ``own``."""
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        at = at[self.hashes[at] == own]
        common = np.bincount(self.owners[runs(self.starts[at], self.counts[at])], minlength=len(self.sizes))
        return np.flatnonzero((100 + percent) * common >= percent * (self.sizes + len(own)))


def _stray_links(percent: int):
    """Reads whole tiles, strays first; yields one link (a, b) per stray and root that it is near to."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile = None, _Strays()
        for batch in batches:
            left, right = [], []
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for i, (bucket, number, visitor, set_id, root, stray) in enumerate(zip(*columns)):
                if (bucket, number) != at:
                    at, tile = (bucket, number), _Strays()
                own = np.frombuffer(batch.column(6)[i].as_buffer(), U64)
                if not visitor:
                    tile.ids.append(set_id)
                    tile.roots.append(root)
                    tile.sets.append(own.copy())
                    continue
                if not tile.ids:
                    continue
                if tile.hashes is None:
                    tile.index()
                for j in tile.near(own, percent):
                    if tile.roots[j] == root or (stray and set_id <= tile.ids[j]) or (j, root) in tile.seen:
                        continue
                    tile.seen.add((j, root))
                    left.append(tile.ids[j])
                    right.append(set_id)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return work


def near_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(id, text) to (id, n_shingles, component)."""
    small_batches(docs.sparkSession)
    sketches = materialize(sketch(docs, size, rows, bands), name="sketches")
    nodes = sketches.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min("id").alias("least"), F.any_value("bands").alias("bands")
    )
    nodes = materialize(nodes, name="sets")
    placed = nodes.select("set_id", F.explode("bands").alias("bucket"))
    members = materialize(placed.join(_hubs(placed), "bucket"), name="members")
    to_hubs = members.select("set_id", F.explode("hubs").alias("hub")).where("set_id != hub")
    pairs = to_hubs.select(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b")).distinct()
    involved = members.select("set_id").distinct().join(nodes.select("set_id", F.col("least").alias("id")), "set_id")
    sets = materialize(full_sets(docs, involved, size), name="shingles")
    first = materialize(compared(pairs, sets), name="compared")
    # 100 * common >= percent * (size_a + size_b - common)
    linked = (100 + percent) * F.col("common") >= percent * (F.col("size_a") + F.col("size_b"))
    links = first.where(linked).select("a", "b")
    roots = components(links).withColumnRenamed("node", "set_id")

    rooted = members.select("bucket", "set_id").join(roots, "set_id", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "set_id")), name="rooted")
    tiles = _stray_rows(rooted, sets).repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "visitor")
    second = tiles.mapInArrow(_stray_links(percent), "a binary, b binary")
    links = materialize(links.union(second), name="links")
    roots = components(links)
    named = nodes.select("set_id", "least").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = named.withColumn("root", F.coalesce("root", "set_id"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    owners = named.join(least, "root").select("set_id", "component")
    return sketches.select("id", "n_shingles", "set_id").join(owners, "set_id", "left").select(
        "id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("component")).alias("component")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    require(docs, [id_col, text_col])
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    found = near_components(texts, **options)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged; rows of one kept id are all kept."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select("doc_id").distinct()
    (key,) = fresh(docs, "kept_id")
    kept = kept.withColumnRenamed("doc_id", key)
    return docs.join(kept, column(id_col).eqNullSafe(F.col(key)), "left_semi")
