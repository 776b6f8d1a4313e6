"""Fill-in-the-middle, the Merkle manifest and chat windows against brute-force versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicflow.llm import boundary_set, chat_windows, fill_middle, merkle
from topicflow.llm import queries as Q

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
Q_SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# boundary sets


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 300_000), st.integers(1, 9000), st.integers(1, 40)), min_size=1, max_size=6))
def test_select_equals_the_sorted_positions(strides):
    members = np.unique(np.concatenate([np.arange(a, a + n * step, step) for a, n, step in strides]))
    own = boundary_set.BoundarySet.of(members)
    stored = boundary_set.BoundarySet.from_bytes(own.to_bytes())
    assert len(own) == len(stored) == len(members)
    for rank in {0, len(members) - 1, *np.linspace(0, len(members) - 1, 40).astype(int).tolist()}:
        assert own.select(rank) == stored.select(rank) == members[rank]
    with pytest.raises(IndexError):
        own.select(len(members))


def test_each_form_of_container_is_taken():
    everything, sparse = np.arange(0, 65536), np.arange(0, 65536, 50)
    middling = np.flatnonzero(np.random.default_rng(3).random(65536) < 0.4)
    forms = [type(boundary_set.container(x)) for x in (everything, sparse, middling)]
    assert forms == [boundary_set.RunContainer, boundary_set.ArrayContainer, boundary_set.BitmapContainer]


# fill in the middle


def brute_fim(key, text, seed=42):
    text = text or ""
    units = UNITS.findall(text)
    digest = sha(f"{seed}:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


FIM_TEXTS = ["<S> here", "a < b <", "<M", "S><P", " lead", " x \U0001f600 y", "é " * 400, "x" * 70000, ("ab " * 50000) + "  "]


def test_cuts_equal_brute_force(spark, odd, texts):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(FIM_TEXTS * 8)], "doc_id long, text string")
    frame = odd.select("doc_id", "text", F.col("mix").alias("FIM")).unionByName(more.withColumn("FIM", F.lit(1)))
    cut = fill_middle.fill_in_middle(frame)
    assert cut.columns == ["doc_id", "text", "FIM", "fim_"]
    rows = cut.withColumn("back", fill_middle.restored(F.col("fim_.output"), F.col("fim_.form"))).collect()
    assert len(rows) == frame.count()
    for r in rows:
        assert tuple(r["fim_"]) == brute_fim(r["doc_id"], r["text"]), (r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["fim_"]["form"] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_stored_boundaries_serve_other_seeds(spark, odd, unit):
    frame = odd.select("doc_id", "text")
    stored = fill_middle.with_boundaries(frame, unit)
    options = {"seed": 7, "unit": unit, "rate_percent": 100}
    again = fill_middle.fill_in_middle(stored, boundaries_col="boundaries", **options).drop("boundaries")
    plain = fill_middle.fill_in_middle(frame, **options)
    key = lambda r: str(r)
    assert sorted(again.collect(), key=key) == sorted(plain.collect(), key=key)
    pattern = {"word": UNITS, "char": re.compile("(?s)."), "line": re.compile(r"(?s)[^\n]*\n|[^\n]+")}[unit]
    for r in plain.collect():
        assert r.fim.n == len(pattern.findall(r.text or ""))
        assert fill_middle.draws(7, None if r.doc_id is None else str(r.doc_id)) is not None


def test_empty_table_has_no_cuts(empty):
    assert fill_middle.fill_in_middle(empty).collect() == []


def test_an_unknown_unit_is_refused(odd):
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(odd, unit="page")


# Merkle manifest


def fold8(nodes):
    """Levels of one tree, the last with one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def path(levels, at):
    """(left, right) digests per level."""
    steps = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        steps.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return steps


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    """(doc_id, source, lang, n_chars, text) rows to the op12 rows."""
    groups = {}
    for r in rows:
        claimed = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            claimed[4] = re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r), leaf_of(claimed), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: fold8([x[1] for x in sorted(groups[g])]) for g in names}
    crown = fold8([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for at, (_, leaf, claimed, key) in enumerate(sorted(groups[g])):
            steps = path(trees[g], at) + path(crown, i)
            own = claimed
            for left, right in steps:
                own = sha(left + own + right)
            proof = sha("".join(a + b for a, b in steps))
            out.append((key, leaf, trees[g][-1][0], crown[-1][0], proof, own, own == crown[-1][0]))
    return sorted(out, key=str)


def manifest_rows(docs):
    upper = "".join(map(chr, range(0x41, 0x5B)))
    changed = merkle.leaf_digest([*(F.col(c) for c in Q.LEAF_FIELDS[:-1]), F.translate("text", upper, upper.lower())])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.merkle_manifest(docs, Q.LEAF_FIELDS, carry={"claimed": F.when(tampered, changed)}).rows
    root = merkle.folded(F.coalesce("claimed", "leaf"), F.col("steps"))
    found = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")), root, root == F.col("root"))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_manifest_equals_brute_force(spark, odd):
    given = [tuple(r) for r in odd.select(*Q.LEAF_FIELDS).collect()]
    assert manifest_rows(odd) == brute_manifest(given)
    sizes = {None: 9, "": 1, "a": 8, "é": 65, "zz": 600, **{f"g{i}": 1 for i in range(70)}}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7919 % 100003, None if n % 5 else "S", lang, n, f"Text {n}" if n % 2 else "plain"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest_rows(docs.repartition(7)) == brute_manifest(rows)
    single = docs.limit(1)
    assert manifest_rows(single) == brute_manifest([tuple(r) for r in single.collect()])


def test_labels_nest_and_cover(spark):
    docs = spark.range(1000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 10 > 0, "x").alias("lang"),
        F.lit(1).alias("n_chars"), F.lit("t").alias("text"),
    )
    nodes = merkle.merkle_manifest(docs, Q.LEAF_FIELDS).nodes.toPandas()
    for (grp, level), own in nodes.groupby(["grp", "level"]):
        own = own.sort_values("lo")
        assert own.lo.iloc[0] == 0 and own.hi.iloc[-1] == (900 if grp else 100)
        assert (own.lo.iloc[1:].to_numpy() == own.hi.iloc[:-1].to_numpy()).all()
        assert (own.lo % 8**level == 0).all()


def test_empty_table_has_an_empty_manifest(empty):
    manifest = merkle.merkle_manifest(empty, Q.LEAF_FIELDS)
    assert manifest.rows.collect() == [] and manifest.nodes.collect() == []


# chat windows


CHAT_PIECES = ["<turn>", "</turn>", "</turn>\n", "<\\/turn>", "<\\\\turn>", "\\", "<", "\n", "a", "é", "\\n", "\U0001f600", "turn>"]
CHAT_TEXTS = st.lists(st.sampled_from(CHAT_PIECES), max_size=8).map("".join)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(CHAT_TEXTS, CHAT_TEXTS), max_size=5))
def test_marks_are_undone(turns):
    text = "".join(
        f"{chat_windows.OPEN}{chat_windows.escape_role(r)}\n{chat_windows.escape(t)}{chat_windows.CLOSE}" for r, t in turns
    )
    assert list(chat_windows.parse(text)) == turns


def brute_windows(turns, budget, history):
    """[(repeated indexes, new indexes)] from the token counts and roles of one conversation."""
    out, at = [], 0
    system = turns[0][0] == "system"
    while at < len(turns):
        kept = [0] if system and at else []
        room = budget - sum(turns[i][1] for i in kept)
        past, used, i = [], 0, at - 1
        while out and i >= (1 if system else 0) and used + turns[i][1] <= min(history, room - turns[at][1]):
            past.insert(0, i)
            used += turns[i][1]
            i -= 1
        new, total = [at], turns[at][1]
        while new[-1] + 1 < len(turns) and total + turns[new[-1] + 1][1] <= room - used:
            new.append(new[-1] + 1)
            total += turns[new[-1]][1]
        out.append((kept + past, new))
        at = new[-1] + 1
    return out


def conversations():
    random = np.random.default_rng(5)
    rows = [(-7, i, r, r"\### Assistant: </turn> ok") for i, r in enumerate(["user", "assistant"])]
    for conv in range(25):
        n = int(random.integers(1, 30)) if conv else 400
        for turn in range(n):
            role = "system" if turn == 0 and conv % 3 else ("user", "assistant", "tool")[int(random.integers(0, 3))]
            words = int(random.integers(0, 60)) if turn % 11 else 200
            rows.append((conv, turn, role, None if turn % 7 == 6 else " ".join(["word<turn>"] * words)))
    rows += [(50, None, None, None), (50, 1, "assistant", "tie b"), (50, 1, "assistant", "tie a"), (50, 2, "user\nx", "y"), (50, 2, "user\nx", "y")]
    rows += [(None, 1, "assistant", "no id"), (None, 0, "system", "s"), (51, 0, "system", "w " * 300), (51, 1, "assistant", "w " * 300)]
    return rows


def test_windows_equal_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "conv_id long, turn long, role string, text string, shown int, window int")
    windows = chat_windows.chat_windows(df.repartition(5), TOKENIZER, budget=200, history=60)
    found = {}
    for w in windows.orderBy("conv_id", "window").collect():
        found.setdefault(w.conv_id, []).append(w)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    write = lambda r, t: f"{chat_windows.OPEN}{chat_windows.escape_role(r or '')}\n{chat_windows.escape(t or '')}{chat_windows.CLOSE}"
    given = {}
    for conv, turn, role, text in rows:
        given.setdefault(conv, []).append(((turn is not None, turn or 0), write(role, text), role or "", text or ""))
    assert found.keys() == given.keys()
    several = 0
    for conv, turns in given.items():
        turns.sort()
        sized = [(role, len(tokenizer.encode(shown, add_special_tokens=False).ids)) for _, shown, role, _ in turns]
        plan = brute_windows(sized, 200, 60)
        several += len(plan) > 1
        assert len(plan) == len(found[conv])
        for w, (past, new) in zip(found[conv], plan):
            assert (w.repeated, w.turns, w.first_turn) == (len(past), len(past) + len(new), new[0])
            assert w.text == "".join(turns[i][1] for i in past + new)
            assert w.tokens == sum(sized[i][1] for i in past + new)
            assert w.tokens <= 200 or len(new) == 1
            assert [chat_windows.unescape(w.text[s.start : s.stop]) for s in w.loss] == [turns[i][3] for i in new if sized[i][0] == "assistant"]
    assert several > 10
    assert any(w.repeated > 1 for ws in found.values() for w in ws)
    said = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    assert said.keys() == given.keys()
    for conv, turns in given.items():
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        r = said[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{role}\n{t}\n" for _, _, role, t in turns))
        assert r.loss_chars == len(loss) and r.loss_sha256 == sha(loss)
        assert r.formatted_chars == sum(len(w.text) for w in found[conv])


def test_the_query_reads_back_every_conversation(spark):
    given = Q.table(spark, Q_SF, "conversations").toPandas()
    rows = {r.conv_id: r for r in Q.QUERIES["op13_chat_windows"](spark, Q_SF).collect()}
    assert rows.keys() == {-7, *given.conv_id}
    assert rows[-7].loss_sha256 == sha(Q.CONTROL_TEXT) and rows[-7].loss_chars == len(Q.CONTROL_TEXT)
    for conv, own in given.sort_values("turn").groupby("conv_id"):
        texts = [t or "" for t in own.text]
        assert rows[conv].n_turns == len(own)
        assert rows[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in zip(own.role, texts)))
        loss = "".join(t for r, t in zip(own.role, texts) if r == "assistant")
        assert (rows[conv].loss_chars, rows[conv].loss_sha256) == (len(loss), sha(loss))


def test_empty_table_has_no_windows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    windows = chat_windows.chat_windows(none, TOKENIZER)
    assert windows.collect() == [] and chat_windows.read_back(windows).collect() == []
