"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its distinct words, ASCII letters in lower case, and of the first letters of its
longer words, hashed into a fixed number of columns: an insult that takes many endings is known by how
it begins, also with an ending that was never learned.  Pairs are looked for among whole words, as a word
and its own beginning always meet.  The model adds a weight per term and, per pair of terms, the product of their factor
vectors: an insult next to the mention of a group may weigh more than both alone.  It is fitted
with a logistic loss on a bounded sample of labelled rows, by mini-batches in one fixed order.

Null and empty texts have no terms and get the score of the bias alone.  Rows with a null label are
not learned from.  With no labelled rows, or one label only, all scores are the share of label 1
(about 0 without rows).  Copies of a labelled text are learned from once, with their mean label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import column, fresh, hash_order, require, small_batches
from .texts import U64, Chunk, RollingHash, _BYTE_CODE, chunks, mix, runs

COLUMNS = 1 << 20
BEGINNING = 4  # letters of a longer word that are a term of their own
WIDTH = COLUMNS + (1 << 18)  # words, then beginnings
FACTORS = 8
# at most about this many labelled rows are learned from, chosen by hash
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
# a term's input is its evidence against these: texts, and standard errors off the mean label share
EVIDENCE_TEXTS = 4.0
EVIDENCE_Z = 3.0
LEAST_INPUT = 0.1
PAIR_TEXTS = 5
PAIR_Z = 5.0
FOLD = 4  # every fourth text sets the scores right
LEAST_UNSEEN = 10  # of either label among those
EPOCHS = 30
BATCH = 128
PAIR_CELLS = 1 << 22  # read at a time when pairs of terms are counted
RATE = 0.5
DECAY = 1e-4
SEED = 11

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _after_letters(data: np.ndarray, begins: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` UTF-8 characters from each of ``begins`` end; the end of the data if there are fewer."""
    characters = np.flatnonzero((data & 0xC0) != 0x80)
    at = np.searchsorted(characters, begins) + count
    return np.concatenate([characters, np.full(count, len(data))])[at]


def terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct terms of all texts, words and beginnings of words, and where each text's terms begin."""
    lowered = chunk.lowered()
    letter = _LETTER[lowered.data]
    starts, stops = letter.copy(), letter.copy()
    starts[1:] &= ~letter[:-1]
    stops[:-1] &= ~letter[1:]
    edges = lowered.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(letter))]
    starts[edges] = letter[edges]
    stops[edges - 1] = letter[edges - 1]
    begins, ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    hashes = RollingHash(_BYTE_CODE[lowered.data])
    owner = np.searchsorted(lowered.offsets, begins, "right") - 1
    cuts = _after_letters(lowered.data, begins, BEGINNING)
    longer = np.flatnonzero(cuts < ends)
    beginning = U64(COLUMNS) + hashes.spans(begins[longer], cuts[longer]) % U64(WIDTH - COLUMNS)
    term = np.concatenate([hashes.spans(begins, ends) % U64(COLUMNS), beginning])
    owner = np.concatenate([owner, owner[longer]])
    pairs = np.unique((owner.astype(U64) << U64(32)) | term)
    owner = (pairs >> U64(32)).astype(np.int64)
    return (pairs & U64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(owner, np.arange(chunk.texts + 1))


@dataclass
class FactorizationMachine:
    """Weights and factors of the ``used`` columns; row 0 of both is that of all other columns."""

    bias: float
    used: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    @cached_property
    def rows(self) -> np.ndarray:
        rows = np.zeros(WIDTH, np.int32)
        rows[self.used] = np.arange(1, len(self.used) + 1)
        return rows

    def scores(self, term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text."""
        return _sigmoid(self.log_odds(term, bounds))

    def log_odds(self, term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        row, bounds = known_cells(self.rows[term], bounds)
        return self.bias + _sums(self.weights, self.factors, row, bounds)[0]


def known_cells(row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells whose term has a row of its own."""
    kept = row > 0
    return row[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(weights: np.ndarray, factors: np.ndarray, row: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the value of all terms and pairs of terms, and the sum of the factor vectors."""
    filled = np.flatnonzero(np.diff(bounds))
    values = np.zeros(len(bounds) - 1)
    sums = np.zeros((len(bounds) - 1, FACTORS))
    if len(filled):
        at, own = bounds[filled], factors[row]
        sums[filled] = np.add.reduceat(own, at, axis=0)
        squares = np.add.reduceat(np.square(own), at, axis=0)
        values[filled] = np.add.reduceat(weights[row], at) + 0.5 * (np.square(sums[filled]) - squares).sum(axis=1)
    return values, sums


def _distinct(term: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Copies of one set of terms as one text with the mean of their labels."""
    sums = np.concatenate([[U64(0)], np.cumsum(mix(term.astype(U64) + U64(1)))])
    _, first, place = np.unique(sums[bounds[1:]] - sums[bounds[:-1]], return_index=True, return_inverse=True)
    counts = bounds[first + 1] - bounds[first]
    means = np.bincount(place, labels) / np.bincount(place)
    return term[runs(bounds[first], counts)], np.concatenate([[0], np.cumsum(counts)]), means


def _evidence(texts: np.ndarray, marked: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Bound on minus the log of the chance of so many marked texts, or so few, at a share."""
    seen = marked / texts
    with np.errstate(divide="ignore", invalid="ignore"):
        high = np.where(marked > 0, marked * np.log(seen / share), 0)
        low = np.where(texts > marked, (texts - marked) * np.log((1 - seen) / (1 - share)), 0)
    return np.nan_to_num(high + low, nan=0.0, posinf=np.inf)


def term_pairs(
    term: np.ndarray, bounds: np.ndarray, labels: np.ndarray, texts: np.ndarray, marked: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of terms whose share of label 1 is far from what their two terms give alone, the surest
    first, and how far off in log odds.

    A pair may have more marked texts than the larger share of its terms and the sum of their log odds
    explain, or fewer than both explain; it must be as sure as one term at ``PAIR_Z`` after allowing
    for the number of pairs.  Terms are passed over only if no pair of theirs can reach that.
    """
    often = texts >= PAIR_TEXTS
    share = labels.mean()
    least = PAIR_Z**2 / 2 + np.log(max(1.0, often.sum() * (often.sum() - 1.0) / 2))
    clean = texts - marked
    own = np.divide(marked, texts, out=np.zeros(len(texts)), where=often)
    # marked texts that more than the mean takes at least; what clean texts of the term with the larger share can show
    high = often & (marked * -np.log(share) >= least)
    shows = np.zeros(len(texts))
    mixed = often & (clean > 0)
    shows[mixed] = -clean[mixed] * np.log(1 - own[mixed])
    low = shows >= least
    needs = least / -np.log(1 - own[low].max()) if low.any() else np.inf
    names = np.flatnonzero(high | low | (often & (clean >= needs)))
    pairs = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    place = np.full(len(texts), -1, np.int32)
    place[names] = np.arange(len(names))
    kept = place[term] >= 0
    cells, bounds = place[term[kept]], np.concatenate([[0], np.cumsum(kept)])[bounds]
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    by_term = np.argsort(cells, kind="stable")
    of_term = np.searchsorted(cells[by_term], np.arange(len(names) + 1))
    own = np.clip(own[names], 1e-9, 1 - 1e-9)
    odds = np.log(own / (1 - own)) - np.log(share / (1 - share)) / 2
    for a in np.flatnonzero((high | low)[names]):
        mine = owner[by_term[of_term[a] : of_term[a + 1]]]
        both, hits = np.zeros(len(names)), np.zeros(len(names))
        cuts = np.cumsum(counts[mine]) // PAIR_CELLS
        for part in np.split(mine, np.flatnonzero(np.diff(cuts)) + 1):
            both += np.bincount(cells[runs(bounds[part], counts[part])], minlength=len(names))
            part = part[labels[part] > 0]
            hits += np.bincount(cells[runs(bounds[part], counts[part])], np.repeat(labels[part], counts[part]), len(names))
        b = np.flatnonzero(both >= PAIR_TEXTS)
        b = b[b != a]
        n, m = both[b], np.minimum(hits[b], both[b])
        added, larger = _sigmoid(odds[a] + odds[b]), np.maximum(own[a], own[b])
        above, below = np.maximum(np.maximum(added, larger), share), np.minimum(added, larger)
        sure, under = _evidence(n, m, above), _evidence(n, m, below)
        over = (m > n * above) & (sure >= least)
        far = np.flatnonzero(over | ((m < n * below) & (under >= least)))
        usual = np.where(over, above, below)[far]
        gaps = np.log((m[far] + usual) / (n[far] - m[far] + 1 - usual)) - np.log(usual / (1 - usual))
        pairs.append((np.where(over, sure, under)[far], np.full(len(far), names[a]), names[b[far]], gaps))
    sure, one, other, gaps = map(np.concatenate, zip(*pairs))
    order = np.argsort(-sure, kind="stable")
    return one[order], other[order], gaps[order]


def _begin(factors: np.ndarray, inputs: np.ndarray, one: np.ndarray, other: np.ndarray, gaps: np.ndarray) -> None:
    """Lets each term's factors begin where its surest pair has its gap: from factors near zero the
    few texts of a rare pair do not move them."""
    done = np.zeros(len(factors), bool)
    for a, b, gap in zip(one, other, gaps):
        if done[b]:
            a, b = b, a
        if done[b]:
            continue
        gap = gap / (inputs[a] * inputs[b])
        if not done[a]:
            factors[a] *= np.sqrt(abs(gap)) / np.linalg.norm(factors[a])
        factors[b] = factors[a] * (gap / np.square(factors[a]).sum())
        done[a] = done[b] = True


def term_inputs(texts: np.ndarray, marked: np.ndarray, share: float) -> np.ndarray:
    """What each term puts into the machine where it occurs, from 0 to 1.

    It grows with the term's evidence: how many standard errors its share of label 1 is off the mean,
    less for terms of few texts.  A weight on a small input is a weight under strong decay, so a rare word
    cannot learn the labels of its texts by heart, and no term is cut off at a count.
    """
    z = (marked - texts * share) / np.sqrt(np.maximum(texts, 1) * share * (1 - share))
    z = z * (texts / (texts + EVIDENCE_TEXTS))
    return np.square(z) / (np.square(z) + EVIDENCE_Z**2)


def calibration(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds that make the labels likeliest, by Newton steps.

    Both are held near 1 and 0 as by one observation, and the slope is never below 1: held-back weights make
    scores too small, and few labels change nothing much.
    """
    x = np.column_stack([odds, np.ones(len(odds))])
    start = np.array([1.0, 0.0])
    loss = lambda w: float(np.logaddexp(0, x @ w).sum() - labels @ (x @ w) + np.square(w - start).sum() / 2)
    found = start
    for _ in range(50):
        p = _sigmoid(x @ found)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(2), x.T @ (p - labels) + found - start)
        size = 1.0
        while size > 1e-6 and loss(found - size * step) > loss(found):
            size /= 2
        found = found - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return max(1.0, float(found[0])), float(found[1])


def _part(term: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms and bounds of some texts."""
    counts = bounds[rows + 1] - bounds[rows]
    return term[runs(bounds[rows], counts)], np.concatenate([[0], np.cumsum(counts)])


def train_machine(term: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> FactorizationMachine:
    """A machine fitted to all texts, with the log odds of its scores set right.

    Inputs by evidence and decay hold the scores back, so a text may well be toxic at a low score.  How far is
    read off texts that a machine did not see: one is fitted without every ``FOLD``-th text, and the slope and
    shift that suit those texts go into the machine of all texts.  Copies of a text are on one side.
    """
    if len(labels):
        term, bounds, labels = _distinct(term, bounds, labels)
    machine = _fit(term, bounds, labels)
    unseen = np.arange(len(labels)) % FOLD == FOLD - 1
    if min(labels[unseen].sum(), (1 - labels[unseen]).sum()) < LEAST_UNSEEN:
        return machine
    seen, unseen = np.flatnonzero(~unseen), np.flatnonzero(unseen)
    other = _fit(*_part(term, bounds, seen), labels[seen])
    slope, shift = calibration(other.log_odds(*_part(term, bounds, unseen)), labels[unseen])
    machine.bias = slope * machine.bias + shift
    machine.weights, machine.factors = slope * machine.weights, np.sqrt(slope) * machine.factors
    return machine


def _fit(term: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> FactorizationMachine:
    """Mini-batches with decay and one step size for all weights, which falls with the gradients seen.

    Terms enter with their ``term_inputs``, those of sure pairs (``term_pairs``) in full.  An input below
    ``LEAST_INPUT`` moves no score, as its weight is held back by the square of it, and is left out.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    machine = FactorizationMachine(
        float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(0, np.int64), np.zeros(1), np.zeros((1, FACTORS))
    )
    if share <= 0 or share >= 1:
        return machine
    texts = np.bincount(term, minlength=WIDTH)
    marked = np.bincount(term, np.repeat(labels, np.diff(bounds)), WIDTH)
    inputs = term_inputs(texts, marked, share)
    words = term < COLUMNS
    own = np.concatenate([[0], np.cumsum(words)])[bounds]
    one, other, gaps = term_pairs(term[words], own, labels, texts[:COLUMNS], marked[:COLUMNS])
    inputs[one] = inputs[other] = 1.0
    machine.used = np.flatnonzero(inputs >= LEAST_INPUT)
    row, bounds = known_cells(machine.rows[term], bounds)
    inputs = np.concatenate([[0.0], inputs[machine.used]])
    random = np.random.Generator(np.random.PCG64(SEED))
    weights = np.zeros(len(machine.used) + 1)
    factors = random.normal(0, 0.02, (len(weights), FACTORS))
    factors[0] = 0
    _begin(factors, inputs, machine.rows[one], machine.rows[other], gaps)
    bias, past_weights, past_factors = machine.bias, 1e-3, 1e-3
    place = np.zeros(len(weights), np.int64)
    seen = np.zeros(len(weights), bool)
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            counts = bounds[batch + 1] - bounds[batch]
            cells = row[runs(bounds[batch], counts)]
            owner = np.repeat(np.arange(len(batch)), counts)
            seen[cells] = True
            used = np.flatnonzero(seen)
            seen[used] = False
            place[used] = np.arange(len(used))
            # texts by terms; sums over a text's or a term's cells are products with it
            table = np.zeros((len(batch), len(used)), np.float32)
            table[owner, place[cells]] = 1
            x = inputs[used]
            own = factors[used] * x[:, None]
            parts = np.column_stack([weights[used] * x - 0.5 * np.square(own).sum(axis=1), own])
            found = (table @ parts.astype(np.float32)).astype(np.float64)
            sums = found[:, 1:]
            values = found[:, 0] + 0.5 * np.square(sums).sum(axis=1)
            slope = (_sigmoid(bias + values) - labels[batch]) / len(batch)
            bias -= RATE * 0.3 * slope.sum()
            if not len(cells):
                continue
            back = np.column_stack([slope, slope[:, None] * sums]).astype(np.float32)
            back = (table.T @ back).astype(np.float64)
            step = back[:, 0] * x + DECAY * weights[used]
            past_weights += np.square(step).sum()
            weights[used] -= RATE * step / np.sqrt(past_weights)
            step = (back[:, 1:] - own * back[:, :1]) * x[:, None] + DECAY * factors[used]
            past_factors += np.square(step).sum()
            factors[used] -= RATE * step / np.sqrt(past_factors)
    machine.bias, machine.weights, machine.factors = bias, weights * inputs, factors * inputs[:, None]
    return machine


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(0)):
            term, bounds = terms(chunk)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(term, pa.int32()))
            labels = batch.column(1).slice(chunk.first, chunk.texts)
            keys = batch.column(2).slice(chunk.first, chunk.texts)
            yield pa.RecordBatch.from_arrays([lists, labels, keys], ["terms", "label", "key"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches), pa.schema([("terms", pa.list_(pa.int32())), ("label", pa.float64()), ("key", pa.float64())]))
    table = table.sort_by("key").combine_chunks()
    lists = table["terms"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    term = lists.flatten().to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    model = train_machine(term, bounds, table["label"].to_numpy())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([model.bias]),
            pa.array([model.used.astype(np.int64).tobytes()], pa.binary()),
            pa.array([model.weights.tobytes()], pa.binary()),
            pa.array([model.factors.tobytes()], pa.binary()),
        ],
        ["bias", "used", "weights", "factors"],
    )


def fit_toxicity(texts: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A machine from (id, text) and (id, label) rows, labels 0 or 1, null labels left out.

    About ``sample_rows`` labels at most are taken by hash, which bounds what is broadcast and what
    meets in one task as hashed terms.
    """
    marks = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull())
    draw = hash_order(F.col("id"), SEED)
    sample = marks.where(draw * F.lit(float(marks.count())) < sample_rows)
    sample = sample.select("id", F.col("label").cast("double").alias("label"), draw.alias("key"))
    fitted = (
        texts.join(F.broadcast(sample), "id")
        .select("text", "label", "key")
        .mapInArrow(_hashed, "terms array<int>, label double, key double")
        .repartition(1)
        .mapInArrow(_train, "bias double, used binary, weights binary, factors binary")
        .collect()[0]  # one row: the model
    )
    return FactorizationMachine(
        fitted["bias"],
        np.frombuffer(fitted["used"], np.int64),
        np.frombuffer(fitted["weights"]),
        np.frombuffer(fitted["factors"]).reshape(-1, FACTORS),
    )


def with_score(df: DataFrame, machine: FactorizationMachine, text: Column, name: str) -> DataFrame:
    """Adds the double ``name``."""
    shared = df.sparkSession.sparkContext.broadcast(machine)  # at most WIDTH * (FACTORS + 2) numbers

    def score(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(*terms(chunk)) for chunk in chunks(texts, 1 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return df.withColumn(name, F.arrow_udf(score, "double")(text))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, a double from 0 to 1, the last column.

    ``labels`` has the id and the label; ``train``, a condition on the id, says which labels
    may be learned from.
    """
    require(docs, [id_col, text_col])
    small_batches(docs.sparkSession)
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    marks = labels.where(train).select(column(id_col).alias("id"), column(label_col).alias("label"))
    (name,) = fresh(docs, "toxicity")
    machine = fit_toxicity(texts, marks, sample_rows)
    return with_score(docs, machine, column(text_col).cast("string"), name)


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    scored = score_toxicity(docs, labels, train, **options)
    name = scored.columns[-1]
    return scored.where(F.col(name) < threshold).drop(name)
