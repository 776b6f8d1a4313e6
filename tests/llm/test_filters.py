import numpy as np
import pyarrow as pa
from brute import by_id
from pyspark.sql import functions as F

from topicflow.llm import queries, toxicity
from topicflow.llm.frames import held_out
from topicflow.llm.languages import LanguageFilters, fit_languages, identify_languages
from topicflow.llm.mixing import mix_rates, mix_sources
from topicflow.llm.quality_rules import host_verdicts, judge_documents
from topicflow.llm.texts import U64, mix
from topicflow.llm.toxicity import drop_toxic, score_toxicity, term_inputs, train_machine

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SF1 = "/root/testdata/sf0.1"


def test_held_out_languages_are_found(spark):
    found = queries.QUERIES["op2_language_bitmask"](spark, SF01)
    truth = queries.table(spark, SF01, "documents").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert rows[0] > 0.98


def test_filters_never_miss_and_seldom_err():
    filters = LanguageFilters([f"l{i}" for i in range(70)], np.zeros((1 << 12, 2), U64))
    keys = mix(np.arange(70 * 200, dtype=U64)).reshape(70, 200)
    for i, own in enumerate(keys):
        filters.add(i, own)
    for i in (0, 63, 64, 69):
        mask = filters.table[filters.slots(keys[i])[0], i // 64]
        for slots in filters.slots(keys[i])[1:]:
            mask = mask & filters.table[slots, i // 64]
        assert ((mask >> U64(i % 64)) & U64(1)).all()
    assert filters.false_positive_rates().max() < 0.01


def test_languages_of_odd_rows(odd):
    found = by_id(identify_languages(odd, F.lit(True)), "doc_id", "language_.lang", "language_.score")
    assert [found[k][0] for k in (2, 3, 4)] == ["und"] * 3
    assert all(0 <= s <= 1 for _, s in found.values())
    assert found[9] == found[10]
    assert identify_languages(odd, F.lit(False)).where("language_.lang <> 'und'").count() == 0


def test_languages_of_an_empty_table(empty):
    assert identify_languages(empty, F.lit(True)).collect() == []
    assert fit_languages(empty.select(F.col("doc_id").alias("id"), "text", "lang")) is None


def test_held_out_insults_are_found(spark):
    found = queries.QUERIES["op3_toxicity_machine"](spark, SF1)
    truth = queries.table(spark, SF1, "labels").select("doc_id", "toxic")
    rows = found.join(truth, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted")).collect()
    shares = {r[0]: r[1] for r in rows}
    # some labels 1 stand at texts with nothing to be found
    assert shares[1] > 0.7 and shares[0] < 0.005


def test_few_labels_still_tell_texts_apart(spark):
    found = queries.QUERIES["op3_toxicity_machine"](spark, SF).agg(F.countDistinct("score"), F.avg("predicted")).first()
    assert found[0] > 10 and found[1] < 0.2


def test_a_terms_input_follows_its_evidence():
    texts, marked = np.array([1, 2, 5, 10, 100, 100, 0]), np.array([1, 2, 5, 10, 100, 10, 0])
    inputs = term_inputs(texts, marked, 0.1)
    assert (np.diff(inputs[:5]) > 0).all()  # no jump at a count
    assert inputs[4] > 0.95 and inputs[0] < 0.1 and inputs[5] == inputs[6] == 0


def test_pairs_of_terms_are_learned():
    random = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(3000):
        a, b = bool(random.random() < 0.25), bool(random.random() < 0.25)
        rows.append([*([1] if a else []), *([2] if b else []), 10 + i % 7])
        labels.append(float(a and b))
    bounds = np.cumsum([0, *map(len, rows)])
    # every text is its own set: a term of its own, too rare to be used
    rows = [[*r, 1000 + i] for i, r in enumerate(rows)]
    bounds = np.cumsum([0, *map(len, rows)])
    machine = train_machine(np.concatenate(rows), bounds, np.array(labels))
    cases, at = np.array([1, 2, 1, 2]), np.array([0, 1, 2, 4])
    only_a, only_b, both = machine.scores(cases, at)
    assert both > 0.7 > 0.25 > max(only_a, only_b)


def test_rare_pairs_of_neutral_terms_are_learned():
    random = np.random.default_rng(0)
    rows, labels = [], []
    # term 1 in 600 texts and term 2 in 3000, 60 of them the same and toxic; each alone is too near the mean
    for i in range(15000):
        own = {*([1] if i < 600 else []), *([2] if i < 60 or 600 <= i < 3540 else [])}
        rows.append(sorted(own | set((1000 + random.integers(0, 2000, 20)).tolist())))
        labels.append(1.0 if i < 60 else float(random.random() < 0.05))
    bounds = np.cumsum([0, *map(len, rows)])
    machine = train_machine(np.concatenate(rows), bounds, np.array(labels))
    assert {1, 2} <= set(machine.used.tolist())
    only_a, only_b, both = machine.scores(np.array([1, 2, 1, 2]), np.array([0, 1, 2, 4]))
    assert both > 0.5 > 0.15 > max(only_a, only_b)


def test_pairs_whose_terms_pass_no_screen_are_learned():
    random = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(15000):
        own = {*([1] if i < 3000 else []), *([2] if i < 60 or 3000 <= i < 5940 else [])}
        rows.append(sorted(own | set((1000 + random.integers(0, 2000, 20)).tolist())))
        # as many toxic texts as make each term's own share the mean of all
        labels.append(float(i < 60 or (i - 60) % 30 == 0 if i < 5940 else i % 20 == 0))
    terms, labels = np.concatenate(rows), np.array(labels)
    bounds = np.cumsum([0, *map(len, rows)])
    for term in (1, 2):
        texts = labels[[term in row for row in rows]]
        assert abs(texts.mean() - labels.mean()) < 5 * np.sqrt(labels.mean() * (1 - labels.mean()) / len(texts))
    machine = train_machine(terms, bounds, labels)
    only_a, only_b, both = machine.scores(np.array([1, 2, 1, 2]), np.array([0, 1, 2, 4]))
    assert both > 0.5 > 0.15 > max(only_a, only_b)


def test_toxicity_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 0), (12, 1), (5, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    scored = score_toxicity(odd, labels, ~held_out(F.col("doc_id")))
    assert scored.columns == [*odd.columns, "toxicity_"]
    assert scored.count() == odd.count()
    assert drop_toxic(odd, labels.limit(0), F.lit(True)).count() == odd.count()


def test_toxicity_of_an_empty_table(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(empty, labels, F.lit(True)).collect() == []


def test_measures_of_odd_rows(odd):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = by_id(judge_documents(odd), "doc_id", *[f"quality_.{f}" for f in fields])
    assert got[2] == got[3] == got[4] == (0, 0, 0, 0, 0, True)
    assert got[1] == (12, 51, 0, 0, 0, False)
    assert got[12] == (7, 39, 0, 1, 0, True)
    assert got[9] == (7800, 7800, 0, 0, 7800, True)
    assert got[11][4] == 5000
    assert judge_documents(odd).columns == [*odd.columns, "quality_"]


def test_a_bad_host_takes_its_good_documents_along(spark):
    bad = [("bad", i % 10 != 0) for i in range(200)]
    rows = [*bad, *[(f"good{h}", i % 20 == 0) for h in range(8) for i in range(100)], ("small", True)]
    verdicts = {r["host"]: r for r in host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert not verdicts["bad"]["host_kept"]
    assert verdicts["good1"]["host_kept"]
    assert verdicts["small"]["host_rate"] < 1


def test_quality_of_an_empty_table(empty):
    assert judge_documents(empty).collect() == []


def test_mix_reaches_its_targets(documents):
    rows = mix_rates(documents).select("source", "mix.*").collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r["copies"]
        target[r.source] = r["target"]
        assert 0 <= r["copies"] <= 3
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert all(target[s] <= 3 * sizes[s] * (1 + 1e-12) for s in sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) < 0.2 * sum(sizes.values())


def test_capped_sources_give_their_excess_to_the_others(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 20, "b"), (3, "w " * 570, "c"), (4, None, "d"), (5, "w", None)]
    got = {r.source: r.mix for r in mix_rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    # 601 words; weights 1, 2, 3, 1, 2: a, b and null stop at 30, 60 and 3, c takes the rest
    assert [got[s].target for s in ("a", "b", "c", "d", None)] == [30.0, 60.0, 508.0, 0.0, 3.0]


def test_mix_emits_the_counted_copies(odd):
    rated = {(r.doc_id, r.text): r.mix_.copies for r in mix_rates(odd).collect()}
    mixed = mix_sources(odd)
    assert mixed.columns == odd.columns
    counts = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    repeats = {(r.doc_id, r.text): r["count"] for r in odd.groupBy("doc_id", "text").count().collect()}
    assert {k: n * repeats[k] for k, n in rated.items() if n} == counts


def test_mix_of_an_empty_table(empty):
    assert mix_sources(empty).collect() == []


def _insulting(rows, seed):
    """Texts of ten usual words, every eighth with one of ten insults, as terms, bounds and labels."""
    random = np.random.default_rng(seed)
    labels = (np.arange(rows) % 8 == 0).astype(float)
    texts = [np.unique(random.integers(100, 600, 10)) for _ in range(rows)]
    texts = [np.append(t, random.integers(1000, 1010)) if m else t for t, m in zip(texts, labels)]
    return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), labels


def test_scores_of_rare_insults_reach_the_threshold():
    """Weights of rare terms are held back; what that takes from the scores is read off texts not learned from."""
    term, bounds, labels = _insulting(1200, 0)
    machine = toxicity.train_machine(term, bounds, labels)
    held_back = toxicity._fit(*toxicity._distinct(term, bounds, labels))
    term, bounds, labels = _insulting(4000, 1)
    caught = lambda m: (m.scores(term, bounds) >= toxicity.THRESHOLD)
    assert caught(held_back)[labels == 1].mean() < 0.85 and caught(machine)[labels == 1].mean() > 0.88
    assert caught(machine)[labels == 0].mean() < 0.01


def test_calibration_stays_near_the_scores_of_few_labels():
    slope, shift = toxicity.calibration(np.array([3.0, -3.0]), np.array([1.0, 0.0]))
    assert 1 <= slope < 1.2 and abs(shift) < 1e-6
    slope, shift = toxicity.calibration(np.array([5.0, -5.0] * 50), np.array([0.0, 1.0] * 50))
    assert slope == 1 and abs(shift) < 1e-6


def test_a_beginning_is_known_with_a_new_ending():
    random = np.random.default_rng(5)
    usual = [f"w{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(300)]
    text = lambda insult: " ".join([*random.choice(usual, 30), *([insult] if insult else [])])
    learned = [text(f"réeu{e}" if i % 8 == 0 else "") for i, e in enumerate(random.choice(usual[:150], 800))]
    asked = [text(f"réeu{e}") for e in usual[150:200]] + [text("") for _ in range(200)]

    def hashed(texts):
        (chunk,) = toxicity.chunks(pa.array(texts))
        return toxicity.terms(chunk)

    machine = toxicity.train_machine(*hashed(learned), (np.arange(800) % 8 == 0).astype(float))
    found = machine.scores(*hashed(asked)) >= toxicity.THRESHOLD
    assert found[:50].mean() > 0.9 and found[50:].mean() < 0.05
    # a word of four letters is no beginning, and the same letters have two terms
    assert [len(hashed([t])[0]) for t in ("réeu", "réeux", "réeu réeux", "réeux réeuy", "")] == [1, 2, 3, 3, 0]
