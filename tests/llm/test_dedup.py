import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import by_id
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicflow.llm import queries
from topicflow.llm.components import components
from topicflow.llm.lm_scoring import cross_entropy_difference
from topicflow.llm.minhash import drop_near_duplicates, near_duplicates
from topicflow.llm.suffix_dedup import drop_repeated_bytes, front_code, front_decode, merge_runs, remove_repeated_bytes
from topicflow.llm.texts import chunks
from topicflow.llm.vector_join import link_vectors
from topicflow.llm.window_dedup import remove_repeated_windows

SF = brute.SF


def plain(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def planted(spark):
    """Passages that cross and overlap, copies, near copies, shifted and periodic texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    passages = [" ".join(rng.choices(vocabulary, k=n)) for n in (12, 19, 20, 21, 40, 90)]
    rows = []
    for i in range(90):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(passages))
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    for i in range(90, 120):
        base = rows[rng.randrange(90)][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, " ".join(base)))
    rows += [(120, "z" * 400), (121, "zz" * 120), (122, "ab" * 300), (123, rows[5][1][7:]), (124, rows[5][1][:-9])]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def suffix_digest(df):
    cut = remove_repeated_bytes(df)
    name = cut.columns[-1]
    return by_id(cut, "doc_id", *[f"{name}.{c}" for c in ("n_bytes", "n_removed", "n_spans")], F.sha2(f"{name}.kept", 256))


def window_digest(df):
    return by_id(remove_repeated_windows(df), "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256))


def test_suffixes_equal_brute_force(documents, planted):
    for df in (documents, planted):
        assert suffix_digest(df) == brute.suffix_dedup(plain(df))


def test_windows_equal_brute_force(documents, planted):
    for df in (documents, planted):
        assert window_digest(df) == brute.window_dedup(plain(df))


def test_near_duplicates_equal_brute_force(documents, planted):
    for df in (documents, planted):
        got = by_id(near_duplicates(df), "doc_id", "n_shingles", "component_id")
        assert got == brute.near_duplicates(plain(df))


def test_a_chain_of_near_copies_is_one_component(spark):
    rng = random.Random(1)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        text = list(text)
        text[rng.randrange(200)] = f"new{i}"
        rows.append((100 - i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(near_duplicates(df), "doc_id", "n_shingles", "component_id")
    assert got == brute.near_duplicates(rows)
    assert drop_near_duplicates(df).count() == len({c for _, c in got.values()})


def test_scores_equal_brute_force(documents, spark):
    target = queries.table(spark, SF, "benchmark")
    got = by_id(cross_entropy_difference(documents, target), "doc_id", "n_tokens", "target_loss", "background_loss")
    want = brute.cross_entropy(plain(documents), [r.text for r in target.collect()])
    assert got.keys() == want.keys()
    for k, (n, near, far) in want.items():
        assert got[k][0] == n
        assert got[k][1:] == (None, None) if near is None else np.allclose(got[k][1:], (near, far), rtol=1e-9)


def test_second_words_that_share_the_first_bits_of_their_hash(spark):
    vocabulary = pa.array([" ".join(f"v{i}" for i in range(20_000))], pa.string())
    (chunk,) = chunks(vocabulary)
    heads = chunk.word_hashes >> np.uint64(40)
    order = np.argsort(heads, kind="stable")
    at = int(np.flatnonzero(np.diff(heads[order]) == 0)[0])
    one, two = (f"v{i}" for i in order[at : at + 2])
    rng = random.Random(5)
    # long enough that the rare first word is not among the hot ones
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(1500))) for i in range(30)]
    rows += [(100, f"seldom {one}"), (101, f"seldom {one}"), (102, f"seldom {two}")]
    target = [f"seldom {two}", "w1 w2"]
    got = by_id(
        cross_entropy_difference(
            spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
        ),
        "doc_id", "n_tokens", "target_loss", "background_loss",
    )
    want = brute.cross_entropy(rows, target)
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(60)]
    for i in range(60, 200):
        rows.append((i, (np.array(rows[i % 30][1]) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.35, 0.5])).tolist()))
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [1.0, None]), (205, [2.0, 1.0]), (206, [4.0, 2.0])]
    rows += [(207, [1e300] * 2), (208, [float("inf")] * 16), (209, [2 * x for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_id(link_vectors(df), "vec_id", "n_links", "component_id")
    rows[207] = (207, [1.0] * 2)
    assert got == brute.vector_links(rows)


def test_vectors_of_many_cells(spark, monkeypatch):
    from topicflow.llm import vector_join

    monkeypatch.setattr(vector_join, "TILE_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).astype("f4").tolist()) for i in range(80)]
    rows += [(i, (np.array(rows[i % 10][1]) + rng.normal(size=12) * 0.2).astype("f4").tolist()) for i in range(80, 400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = by_id(link_vectors(df, blocks=4), "vec_id", "n_links", "component_id")
    assert got == brute.vector_links(rows)


def test_vectors_stay_where_they_lie(spark, monkeypatch):
    """Many cells that all reach each other: what is moved and written follows the vectors, not their visits."""
    from topicflow.llm import vector_join

    monkeypatch.setattr(vector_join, "TILE_ROWS", 8)
    monkeypatch.setattr(vector_join, "HOME_BYTES", 12 * 4 * 300, raising=False)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=12).astype("f4").tolist()) for i in range(100)]
    rows += [(i, (np.array(rows[i % 20][1]) + rng.normal(size=12) * 0.2).astype("f4").tolist()) for i in range(100, 300)]
    rows += [rows[0], (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    moved, written = [], []
    repartition, stage = type(df).repartition, vector_join.materialize

    def counted(frame, *args):
        moved.append(frame.count())
        return repartition(frame, *args)

    def staged(frame, *args, name="stage"):
        table = stage(frame, *args, name=name)
        written.append(table.count())
        return table

    monkeypatch.setattr(type(df), "repartition", counted)
    monkeypatch.setattr(vector_join, "materialize", staged)
    got = sorted((r.n_links, r.vec_id or -1) for r in link_vectors(df, blocks=4).collect())
    assert sum(moved) <= len(rows) and max(written) <= len(rows)
    numbered = [(i, v) for i, (_, v) in enumerate(rows)]
    want = brute.vector_links(numbered)
    assert got == sorted((want[i][0], k or -1) for i, (k, _) in enumerate(rows))


def test_a_link_at_the_edge_of_a_block_counts_once(spark):
    from topicflow.llm.vector_join import BLOCKS, LIMIT, SLACK, rotation

    rng = np.random.default_rng(6)
    size = 64
    edges = np.linspace(0, size, BLOCKS + 1).round().astype(int)
    budget = (2 - 2 * LIMIT) / BLOCKS + SLACK
    rows = []
    for i in range(40):
        one = rng.normal(size=size)
        one /= np.linalg.norm(one)
        other = one.copy()
        # turns one vector inside some blocks, so far that its squared distance there ends just under the budget
        for block in range(i % (BLOCKS - 1) + 1):
            a, e = edges[block], edges[block + 1]
            across = rng.normal(size=e - a)
            across -= one[a:e] * (across @ one[a:e]) / np.square(one[a:e]).sum()
            across *= np.linalg.norm(one[a:e]) / np.linalg.norm(across)
            cosine = 1 - (budget - SLACK / 4) / (2 * np.square(one[a:e]).sum())
            other[a:e] = cosine * one[a:e] + np.sqrt(1 - cosine**2) * across
        rows += [(2 * i, (rotation(size) @ one).tolist()), (2 * i + 1, (rotation(size) @ other).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = by_id(link_vectors(df), "vec_id", "n_links", "component_id")
    assert got == brute.vector_links(rows) == {i: (1, i - i % 2) for i in range(80)}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    edges += [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(70)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert got == {k: find(k) for k in parent}


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.binary(min_size=4, max_size=4).map(lambda b: bytes(x % 3 for x in b)), max_size=12), min_size=1, max_size=9))
def test_merged_runs_are_sorted_with_their_prefixes(runs):
    runs = [sorted(r) for r in runs]
    common = lambda a, b: next((i for i in range(4) if a[i] != b[i]), 4)
    shared = [[0, *[common(a, b) for a, b in zip(r, r[1:])]][: len(r)] for r in runs]
    order, prefixes = merge_runs(runs, shared)
    heads = [iter(r) for r in runs]
    merged = [next(heads[i]) for i in order]
    assert merged == sorted(x for r in runs for x in r)
    assert prefixes[1:] == [common(a, b) for a, b in zip(merged, merged[1:])]


@settings(deadline=None, max_examples=50)
@given(st.lists(st.binary(min_size=6, max_size=6).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=20))
def test_front_coding_is_undone(rows):
    rows.sort()
    shared, rest = front_code(np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 6))
    assert front_decode(shared, rest, 6) == rows


def test_odd_rows(odd, texts):
    known = odd.where("doc_id is not null")
    assert suffix_digest(known) == brute.suffix_dedup(texts)
    assert window_digest(known) == brute.window_dedup(texts)
    assert by_id(near_duplicates(known), "doc_id", "n_shingles", "component_id") == brute.near_duplicates(texts)
    for cut in (remove_repeated_bytes(odd), remove_repeated_windows(odd), near_duplicates(odd)):
        assert cut.count() == odd.count()
    assert drop_repeated_bytes(odd).columns == odd.columns
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # 6 equals 5, 10 equals 9, and the null id equals 1; null ids without a text stay
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == sorted([1, 2, 3, 4, 5, 7, 8, 9, 11, 12, 13, 14, None], key=str)
    scores = by_id(cross_entropy_difference(odd, odd.limit(3)), "doc_id", "n_tokens", "score")
    assert scores[2] == scores[3] == (0, None)
    assert np.allclose(scores[9], scores[10])


def test_empty_tables(empty, spark):
    for cut in (remove_repeated_bytes, remove_repeated_windows, near_duplicates, drop_near_duplicates, drop_repeated_bytes):
        assert cut(empty).collect() == []
    assert cross_entropy_difference(empty, empty).collect() == []
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_a_group_of_near_copies_meets_few_hubs(spark, monkeypatch):
    """The buckets of a large group choose the same hubs: pairs grow with its members, not with members and bands."""
    from topicflow.llm import minhash
    from topicflow.session import materialize

    random = np.random.default_rng(0)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        words[random.integers(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    counts = {}

    def counted(df, *by, name="stage"):
        table = materialize(df, *by, name=name)
        counts[name] = table.count()
        return table

    monkeypatch.setattr(minhash, "materialize", counted)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}
    assert counts["compared"] < 4 * minhash.HUBS * len(rows)
