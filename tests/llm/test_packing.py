import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicflow.llm.packing import best_two_fit, pack
from topicflow.llm.texts import chunks
from topicflow.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(PATH)
TOKENIZER = Tokenizer.from_file(PATH)
PIECES = ["a", "b'", "'s", "'re", " ", "  ", "\n", "\t", "\r\n", "é", " ", " ", "　", "\x1c", "\x85", "9", "!", "東", "<|endoftext|>", "<|endof"]


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    out = []
    for chunk in chunks(pa.array(texts, pa.string()), 64):
        ids, bounds = ENCODER.encode_chunk(chunk)
        out += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    return out


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=20))
def test_ids_equal_the_tokenizer(texts):
    assert encoded([*texts, None]) == [plain_ids(t) for t in [*texts, None]]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 60), max_size=120), st.integers(60, 80))
def test_patterns_use_every_piece_once(lengths, capacity):
    histogram = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int)
    used = np.zeros(capacity + 1, int)
    for pattern in best_two_fit(histogram, capacity):
        assert sum(pattern.lengths) <= capacity
        np.add.at(used, pattern.lengths, pattern.bins)
    assert (used == histogram).all()


def test_two_smaller_pieces_fill_the_gap_better():
    histogram = np.bincount([6, 3, 2, 2], minlength=11)
    assert [sorted(p.lengths) for p in best_two_fit(histogram, 10)] == [[2, 2, 6], [3]]


def check_layout(rows, texts, seq_len):
    ids = {k: plain_ids(t) + [0] for k, t in texts}
    pieces = {}
    for r in rows:
        assert r["length"] <= seq_len
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for key, own in pieces.items():
        own.sort()
        assert [p for p, _, _ in own] == list(range(len(own)))
        assert [s for _, s, _ in own] == np.cumsum([0, *[n for _, _, n in own[:-1]]]).tolist()
        assert sum(n for _, _, n in own) == len(ids[key])
        assert all(n == seq_len for _, _, n in own[1:])
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist()
        assert own[-1][0] + own[-1][1] <= seq_len
    return len(sequences), sum(len(v) for v in ids.values())


def test_all_documents_are_packed_tightly(documents):
    rows = pack(documents, PATH).collect()
    texts = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    sequences, tokens = check_layout(rows, texts, 2048)
    assert sequences <= tokens / 2048 * 1.01 + 1


def test_odd_rows(odd, texts):
    frame = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_layout(pack(frame, PATH, seq_len=64).collect(), texts, 64)
    whole = pack(odd, PATH, keep_ids=True)
    assert whole.where("doc_id is null").count() == 2
    assert whole.where(F.octet_length("ids") != 4 * F.col("length")).count() == 0


def test_empty_table(empty):
    assert pack(empty, PATH).collect() == []
