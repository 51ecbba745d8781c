import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from umbra.llm import kernels, minhash
from umbra.llm.components import components
from umbra.llm.kernels import Words, blocks, narrow, rabin_karp, utf8, widen, window_hashes, window_starts
from umbra.llm.minhash import near_duplicates
from umbra.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(docs, width=13):
    """(id, words, removed, digest) by dictionaries of word tuples."""
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    for d, t in docs:
        if d is None:
            w = WORD.findall(t or "")
            for i in range(len(w) - width + 1):
                first.setdefault(tuple(w[i : i + width]), float("inf"))
    out = []
    for d, t in docs:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (float("inf") if d is None else d):
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_components(docs, width=4, percent=80):
    """(id, shingles, component, kept) by comparing all pairs."""
    sets = collections.defaultdict(list)
    for d, t in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d].append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d in sets if d is not None]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted(((d, len(s), find(d) if d is not None else None, find(d) == d) for d, many in sets.items() for s in many), key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"word{i}" for i in range(400)]
    shared = [r.choices(vocab, k=40) for _ in range(3)]
    docs = []
    for d in range(n):
        w = r.choices(vocab, k=r.randrange(0, 120))
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)
        if docs and r.random() < 0.4:
            w = docs[r.randrange(len(docs))][1].split()
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
        docs.append((d * 3 + 1, " ".join(w)))
    return docs


def test_substrings_match_brute_force(make_docs, awkward):
    docs = corpus(1) + [(d, t) for d, t, *_ in awkward]
    got = substring_dedup(make_docs(docs), carry=("lang", "id"))
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=repr) == brute_substrings(docs)
    for r in rows:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and r.id == "x"
        assert r.kept_text is None or len(WORD.findall(r.kept_text)) == r.n_words - r.n_removed


@pytest.mark.parametrize("width", [1, 3])
def test_substrings_other_widths(make_docs, width):
    docs = corpus(2, 25)
    got = substring_dedup(make_docs(docs), width=width, full=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(docs, width)


def test_empty_tables(make_docs):
    assert substring_dedup(make_docs([])).collect() == []
    assert near_duplicates(make_docs([])).collect() == []
    assert substring_dedup(make_docs([(1, None)]), full=False).first().n_words == 0


def test_near_duplicates_match_brute_force(make_docs, awkward, monkeypatch):
    monkeypatch.setattr(minhash, "COMPARE", 3)  # families and entries of several blocks
    monkeypatch.setattr(minhash, "NEAR", 3)
    monkeypatch.setattr(minhash, "PIVOTS", 1)
    monkeypatch.setattr("umbra.llm.components.TASK", 16)
    base = " ".join(f"v{i}" for i in range(80)).split()
    r = random.Random(3)
    family = []
    for d in range(40):  # copies with up to 10 edits: similar to some of the others only
        w = list(base)
        for _ in range(r.randrange(10)):
            w[r.randrange(80)] = f"z{r.randrange(1000)}"
        family.append((1000 + d, " ".join(w)))
    docs = corpus(4, 50) + [(d, t) for d, t, *_ in awkward if d != 7] + family + [(2000 + k, "the same text again and again") for k in range(20)]
    got = near_duplicates(make_docs(docs), width=4).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_components(docs)


def test_threshold_of_signatures():
    """Pairs within the distance always share an index entry."""
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, minhash.FIELDS).astype("<u2")
    for _ in range(200):
        b = a.copy()
        b[r.choice(minhash.FIELDS, minhash.THRESHOLD, replace=False)] ^= 1
        batch = pa.record_batch({"id": pa.array([1, 2]), "sig": pa.array([a.tobytes(), b.tobytes()], pa.binary())})
        out = next(minhash._entries([batch]))
        keys = collections.defaultdict(set)
        for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            keys[k].add(i)
        assert any(len(v) == 2 for v in keys.values())


@pytest.mark.parametrize("task", [2, 1 << 16])
def test_components(spark, monkeypatch, task):
    monkeypatch.setattr("umbra.llm.components.TASK", task)  # rounds of stars, or one task
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (100, 95)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_kernels():
    texts = ["Über alles  x", "", None, " a\tb\nc ", "ÀB"]
    raw, off = utf8(pa.array(texts))
    w = Words(raw, off)
    assert [raw[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == ["Über", "alles", "x", "a", "b", "c", "ÀB"]
    assert w.counts().tolist() == [3, 0, 0, 3, 1]
    low = Words(raw, off, lower=True, alnum=True)
    raw2, off2 = utf8(pa.array(["über", "àb"]))
    assert Words(raw2, off2).hash.tolist() == [low.hash[0], low.hash[-1]]
    at, per_text = window_starts(w.word_off, 2)
    assert at.tolist() == [0, 1, 3, 4] and per_text.tolist() == [2, 0, 0, 2, 0]
    h = np.array([5, 6, 7, 5, 6], np.uint64)
    assert window_hashes(h, 2)[0] == window_hashes(h, 2)[3] and len(set(window_hashes(h, 2).tolist())) == 3
    assert list(blocks(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]
    for values in ([0, 255], [256, 3], [1 << 40], []):
        v = np.array(values, np.uint64)
        assert widen(narrow(v), len(values)).tolist() == values


def test_words_that_meet_under_powers_of_one_base(make_docs):
    """A Thue-Morse word and its complement share a polynomial hash modulo 2**64 from 1,024 letters on."""
    bits = [0]
    while len(bits) < 2048:
        bits += [1 - b for b in bits]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    w = Words(*utf8(pa.array([f"{one} {other}"])))
    assert len(set(w.hash.tolist())) == 2
    many = rabin_karp(w.hash[np.array(bits)], 1024)  # the same pattern over words
    assert len(set(many.tolist())) == len({tuple(bits[i : i + 1024]) for i in range(1025)})
    rest = " ".join(f"r{i}" for i in range(12))
    docs = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest}")]
    assert [r.n_removed for r in substring_dedup(make_docs(docs), full=False).orderBy("doc_id").collect()] == [0, 0, 13]
    assert sorted((tuple(x) for x in near_duplicates(make_docs(docs), width=4).collect()), key=repr) == brute_components(docs)


def test_rabin_karp_is_the_polynomial():
    h = np.random.default_rng(0).integers(0, 1 << 64, 60, dtype=np.uint64)
    p = (1 << 61) - 1
    for width in (1, 2, 3, 5, 8, 13, 60):
        want = [sum(int(x) * pow(kernels._BASE, width - 1 - k, p) for k, x in enumerate(h[i : i + width])) % p for i in range(60 - width + 1)]
        assert rabin_karp(h, width).tolist() == want
