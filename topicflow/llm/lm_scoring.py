"""Cross-entropy difference between a target and a background bigram model.

Both models share the vocabulary of all words of both corpora (ASCII letters in lower case) and one
rule: p(w | v) = (c(v, w) + prior / V) / (c(v) + prior), the first word of a text following a start
mark.  They are matched in size: background counts are scaled to the number of target words.  A
text's losses are the mean negative log probabilities of its words; its score is the target's loss
minus the background's, so the lower, the closer to the target.

Counts cover all texts, with no cut on the vocabulary, so the model grows with the corpus and is
never gathered: each text's bigrams are sent to the part of their first word, where both counts are
added up and each text gets its share of the losses back.  First words that make up more than
1 / ``HOT_SHARE`` of all bigrams are fewer than that; their totals are broadcast and their bigrams
spread by both words.

Words are told apart by 64 bits of hash, bigrams of a hot first word by 64 bits of both words, second
words behind another first word by 48 bits: behind one first word with a million different followers
two share them with a probability of 0.002.

Texts without words and nulls have no tokens and null losses and scores.  Rows that repeat an id
and its text are counted as often as they occur and get one score.  Without target words all target
probabilities are 1 / V, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .frames import require
from .runs import LAST_ID, TEXT_KEYS, by_part, keyed_texts, part_of, parts_for, squeeze, widen
from .texts import U64, Chunk, chunks, mix

PRIOR = 10.0
HOT_SHARE = 10_000
KEYS_PER_PART = 500_000
HELD_WORDS = 250_000
CHUNK_BYTES = 1 << 20
HELD_SUMS = 400_000
START = U64(0x5354415254)
# of the second word's hash, behind a first word's whole hash
TAIL_BITS = 48
BIGRAM_SCHEMA = (
    "part integer, n integer, n_keys integer, ids binary, hashes binary, keys binary, lengths binary, tails binary, "
    "times binary, text binary, place binary"
)
_BIGRAM_NAMES = [f.split()[0] for f in BIGRAM_SCHEMA.split(", ")]


def _bigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, second word, text) of all bigrams, start marks included."""
    lowered = chunk.lowered()
    words, bounds = lowered.word_hashes, lowered.word_bounds
    first = np.empty_like(words)
    first[1:] = words[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = START
    return first, words, np.repeat(np.arange(chunk.texts), np.diff(bounds))


def _bigram_rows(
    parts: int,
    ids: np.ndarray,
    hashes: np.ndarray,
    key: np.ndarray,
    tail: np.ndarray,
    text: np.ndarray,
    place: np.ndarray,
    times: np.ndarray,
) -> pa.RecordBatch:
    """One row per part from bigrams in ascending order of key.  A key goes once, with the number of its
    bigrams; tails go with the bigrams whose key does not name the second word (place 0 and 1)."""
    part = part_of(key, parts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows: list[list] = [[] for _ in _BIGRAM_NAMES]
    for a, b in zip([0, *cuts], [*cuts, len(key)]):
        used, own = np.unique(text[a:b], return_inverse=True)
        starts = np.flatnonzero(np.append(True, key[a + 1 : b] != key[a : b - 1]))
        values = [
            int(part[a]),
            b - a,
            len(starts),
            ids[used].tobytes(),
            hashes[used].tobytes(),
            squeeze(np.diff(key[a:b][starts], prepend=U64(0))),
            squeeze(np.diff(np.append(starts, b - a))),
            squeeze(tail[a:b][place[a:b] < 2]),
            squeeze(times[a:b]),
            squeeze(own),
            squeeze(place[a:b]),
        ]
        for column_, value in zip(rows, values):
            column_.append(value)
    types = [*[pa.int32()] * 3, *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], _BIGRAM_NAMES)


def _bigram_entries(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("id", "hash", "key", "tail", "times", "place")}
    for batch in held:
        for row in batch.to_pylist():
            n, n_keys = row["n"], row["n_keys"]
            text, place = widen(row["text"], n).astype(np.int64), widen(row["place"], n).astype(np.int64)
            tail = np.zeros(n, U64)
            named = place < 2
            tail[named] = widen(row["tails"], int(named.sum()))
            found["id"].append(np.frombuffer(row["ids"], np.int64)[text])
            found["hash"].append(np.frombuffer(row["hashes"], np.int64)[text])
            found["key"].append(np.repeat(np.cumsum(widen(row["keys"], n_keys)), widen(row["lengths"], n_keys).astype(np.int64)))
            found["tail"].append(tail)
            found["times"].append(widen(row["times"], n).astype(np.uint32))
            found["place"].append(place)
    return {k: np.concatenate(v) for k, v in found.items()}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash, text, target) to (word, as_first, background, target) counts, added up within a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        words, place = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        counts = np.concatenate([c for _, c in held])
        return words, np.stack([np.bincount(place, counts[:, i], len(words)) for i in range(4)], 1)

    def rows() -> pa.RecordBatch:
        words, counts = summed()
        counts = counts.astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(words.view(np.int64)), *(pa.array(counts[:, i]) for i in range(4))], ["word", "n", "target_n", "first", "target_first"]
        )

    for batch in batches:
        flags = batch.column(3).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(2), CHUNK_BYTES):
            first, second, text = _bigrams(chunk)
            target = flags[chunk.first + text] if len(text) else np.zeros(0, bool)
            for words, at in ((second, 0), (first, 2)):
                own, place = np.unique(words, return_inverse=True)
                counts = np.zeros((len(own), 4))
                counts[:, at] = np.bincount(place, ~target, len(own))
                counts[:, at + 1] = np.bincount(place, target, len(own))
                held.append((own, counts))
            if sum(len(w) for w, _ in held) > 2 * HELD_WORDS:
                held = [summed()]
                if len(held[0][0]) > HELD_WORDS:
                    yield rows()
                    held = []
    if held:
        yield rows()


def score_texts(corpus: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(id, hash, text, target) to (id, hash, n_tokens, target_loss, background_loss) of the texts
    that are not target; the losses are sums."""
    context = corpus.sparkSession.sparkContext
    words = corpus.mapInArrow(_count_words, "word long, n long, target_n long, first long, target_first long")
    words = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "target_n", "first", "target_first")])
    words = materialize(words, name="words")
    seen = F.col("n") + F.col("target_n") > 0
    n, target_n, vocabulary = words.agg(F.sum("n"), F.sum("target_n"), F.count(F.when(seen, 1))).first()
    n, target_n, vocabulary = n or 0, target_n or 0, max(vocabulary, 1)
    total = n + target_n
    hot = words.where((F.col("first") + F.col("target_first")) * HOT_SHARE > total).toArrow()  # fewer than HOT_SHARE rows
    order = np.argsort(hot["word"].to_numpy().view(U64))
    hot_words = context.broadcast([hot[c].to_numpy()[order] for c in ("word", "first", "target_first")])
    scale = target_n / n if n else 1.0
    parts = parts_for(total, KEYS_PER_PART)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = hot_words.value[0].view(U64)
        for batch in batches:
            all_ids, all_hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flags = batch.column(3).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(2), CHUNK_BYTES):
                first, second, text = _bigrams(chunk)
                if not len(first):
                    continue
                at = np.searchsorted(heads, first)
                is_hot = np.zeros(len(first), bool)
                if len(heads):
                    is_hot = heads[np.minimum(at, len(heads) - 1)] == first
                # the key of a hot word's bigram names both words, that of the others the first
                key = np.where(is_hot, mix(first ^ mix(second)), first)
                tail = np.where(is_hot, U64(0), second >> U64(64 - TAIL_BITS))
                place = np.where(is_hot, 2 * at + 2, 0) + flags[chunk.first + text]
                order = np.lexsort((text, tail, key))
                key, tail, text, place = key[order], tail[order], text[order], place[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (tail[1:] != tail[:-1]) | (text[1:] != text[:-1])
                times = np.diff(np.append(np.flatnonzero(new), len(key)))
                mine = slice(chunk.first, chunk.first + chunk.texts)
                yield _bigram_rows(parts, all_ids[mine], all_hashes[mine], key[new], tail[new], text[new], place[new], times)

    def losses(e: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marks of the background entries, and for these the losses times their occurrences."""
        order = np.lexsort((e["tail"], e["key"]))
        for name in e:
            e[name] = e[name][order]
        times = e["times"].astype(np.float64)
        target = (e["place"] & 1).astype(bool)
        new_first = np.ones(len(order), bool)
        new_first[1:] = (e["key"][1:] != e["key"][:-1]) | (e["place"][1:] // 2 != e["place"][:-1] // 2)
        new_pair = new_first.copy()
        new_pair[1:] |= e["tail"][1:] != e["tail"][:-1]
        pair, first = np.cumsum(new_pair) - 1, np.cumsum(new_first) - 1

        def counts(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return np.bincount(group, times * ~target)[group], np.bincount(group, times * target)[group]

        pair_n, pair_target = counts(pair)
        first_n, first_target = counts(first)
        is_hot = e["place"] > 1
        at = e["place"][is_hot] // 2 - 1
        first_n[is_hot], first_target[is_hot] = hot_words.value[1][at], hot_words.value[2][at]
        base = prior / vocabulary
        own = ~target
        target_loss = -np.log((pair_target[own] + base) / (first_target[own] + prior))
        background_loss = -np.log((scale * pair_n[own] + base) / (scale * first_n[own] + prior))
        return own, target_loss * times[own], background_loss * times[own]

    def added(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        ids, hashes, *sums = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort((hashes, ids))
        ids, hashes = ids[order], hashes[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        return [ids[at], hashes[at], *(np.add.reduceat(s[order], at) if len(at) else s for s in sums)]

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "hash", "n_tokens", "target_loss", "background_loss"]
        held: list[list[np.ndarray]] = []
        for rows in by_part(batches):
            entries = _bigram_entries(rows)
            own, target_loss, background_loss = losses(entries)
            times = entries["times"][own].astype(np.int64)
            held = [added([*held, [entries["id"][own], entries["hash"][own], times, target_loss, background_loss]])]
            if len(held[0][0]) > HELD_SUMS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)

    # as many tasks as the cluster's cores can use, whatever the data: each reads its parts one by one
    # and sends on one sum per text
    tasks = min(parts, 4 * context.defaultParallelism)
    placed = corpus.mapInArrow(send, BIGRAM_SCHEMA).repartition(tasks, "part").sortWithinPartitions("part")
    sums = placed.mapInArrow(receive, "id long, hash long, n_tokens long, target_loss double, background_loss double")
    return sums.groupBy(*TEXT_KEYS).agg(*[F.sum(c).alias(c) for c in ("n_tokens", "target_loss", "background_loss")])


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", prior: float = PRIOR
) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score: one row per row of ``docs``, which are
    also the background; ``target`` holds the target texts."""
    require(docs, [id_col, text_col])
    texts = keyed_texts(docs, id_col, text_col)
    aim = keyed_texts(target.withColumn("_lm_id", F.lit(0)), "_lm_id", target_text_col)
    corpus = texts.withColumn("target", F.lit(False)).union(aim.withColumn("target", F.lit(True)))
    scores = score_texts(corpus, prior)
    copies = texts.groupBy(*TEXT_KEYS).agg(F.count("*").alias("copies"))
    scores = scores.join(copies, TEXT_KEYS)
    # sums of repeated rows cover all of them
    per_row = scores.select(
        *TEXT_KEYS,
        (F.col("n_tokens") / F.col("copies")).cast("long").alias("n_tokens"),
        (F.col("target_loss") / F.col("n_tokens")).alias("target_loss"),
        (F.col("background_loss") / F.col("n_tokens")).alias("background_loss"),
    )
    joined = texts.select(*TEXT_KEYS).join(per_row, TEXT_KEYS, "left")
    return joined.select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"),
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        "target_loss",
        "background_loss",
        (F.col("target_loss") - F.col("background_loss")).alias("score"),
    )
