"""Brute-force counterparts, on plain Python rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode())


def suffix_dedup(rows, length=100):
    """(doc_id, text) rows to {doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    out = {}
    for key, data, covered, kept in suffix_cuts(rows, length):
        spans = len(re.findall(b"\x01+", bytes(covered)))
        out[key] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


def suffix_cuts(rows, length=100):
    """(doc_id, bytes, covered, kept bytes) of each (doc_id, text) row."""
    seen = set()
    for key, text in sorted(rows):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for at in range(len(data) - length + 1):
            own = data[at : at + length]
            if own in seen:
                covered[at : at + length] = b"\1" * length
            seen.add(own)
        yield key, data, covered, bytes(b for b, c in zip(data, covered) if not c)


def window_dedup(rows, length=20):
    seen, out = set(), {}
    for key, text in sorted(rows):
        own = words(text)
        covered = [False] * len(own)
        for at in range(len(own) - length + 1):
            window = tuple(own[at : at + length])
            if window in seen:
                covered[at : at + length] = [True] * length
            seen.add(window)
        kept = b" ".join(w for w, c in zip(own, covered) if not c)
        out[key] = (len(own), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


def shingle_set(text, size=3):
    own = [w.lower() for w in words(text)]
    if 0 < len(own) < size:
        return {tuple(own)}
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}


def near_duplicates(rows, percent=85, size=3):
    """(doc_id, text) rows to {doc_id: (n_shingles, component_id)}."""
    sets = {k: shingle_set(t, size) for k, t in rows}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            common = len(x & y)
            if 100 * common >= percent * (len(x) + len(y) - common):
                a_root, b_root = find(a), find(b)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return {k: (len(sets[k]), find(k)) for k in sets}


def cross_entropy(rows, target, prior=10.0):
    """(doc_id, text) rows and target texts to {doc_id: (n_tokens, target_loss, background_loss)}."""

    def pairs(text):
        own = [w.lower() for w in words(text)]
        return list(zip([None, *own], own))

    background, aim = Counter(), Counter()
    for _, text in rows:
        background.update(pairs(text))
    for text in target:
        aim.update(pairs(text))
    first, first_aim = Counter(), Counter()
    for (v, _), n in background.items():
        first[v] += n
    for (v, _), n in aim.items():
        first_aim[v] += n
    vocabulary = len({w for _, w in background} | {w for _, w in aim})
    total, total_aim = sum(background.values()), sum(aim.values())
    scale, base = total_aim / total, prior / vocabulary
    out = {}
    for key, text in rows:
        own = pairs(text)
        if not own:
            out[key] = (0, None, None)
            continue
        near = sum(-math.log((aim[p] + base) / (first_aim[p[0]] + prior)) for p in own) / len(own)
        far = sum(-math.log((scale * background[p] + base) / (scale * first[p[0]] + prior)) for p in own) / len(own)
        out[key] = (len(own), near, far)
    return out


def vector_links(rows, limit=0.9):
    """(vec_id, vector) rows to {vec_id: (n_links, component_id)}."""
    good = {
        k: v for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    }
    links = {k: [] for k, _ in rows}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y):
                dot = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
                if dot >= limit:
                    links[a].append(b)
    out = {}
    for start in sorted(links):
        if start in out:
            continue
        group, todo = {start}, [start]
        while todo:
            for b in links[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        for k in group:
            out[k] = (len(links[k]), start)
    return out
