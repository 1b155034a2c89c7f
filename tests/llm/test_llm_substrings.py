"""Substring dedup over words: the index, its parts, and whole tables against brute force."""
import hashlib
import random

import numpy as np
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from pricewise.llm import places
from pricewise.llm import substrings as S
from pricewise.llm.fm_index import FMIndex, WaveletTree


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(0)
    for symbols in (1, 2, 3, 17, 200):
        s = rng.integers(0, symbols, 500)
        tree = WaveletTree(s, symbols)
        c, at = rng.integers(0, symbols, 300), rng.integers(0, 501, 300)
        assert tree.rank(c, at).tolist() == [int((s[:i] == x).sum()) for x, i in zip(c, at)]


def strings(rng, n, longest, symbols):
    return [rng.integers(1, symbols + 1, int(rng.integers(0, longest + 1))) for _ in range(n)]


@pytest.mark.parametrize("symbols, cap", [(1, 5), (2, 6), (3, 20), (9, 4)])
def test_matching_statistics_match_brute_force(symbols, cap):
    rng = np.random.default_rng(symbols)
    own, queries = strings(rng, 12, 40, symbols), strings(rng, 12, 40, symbols + 2)
    index = FMIndex(np.concatenate(own), np.array([len(s) for s in own]), cap)
    starts = np.cumsum([len(s) + 1 for s in own]) - np.array([len(s) + 1 for s in own])
    size = np.array([len(s) for s in queries])
    got, lo, hi = index.matching_statistics(np.concatenate(queries), size)
    at = 0
    for q in queries:
        for p in range(len(q)):
            best, where = 0, set()
            for length in range(1, min(cap, len(q) - p) + 1):
                found = {int(b) + i for b, s in zip(starts, own) for i in range(len(s) - length + 1) if (s[i:i + length] == q[p:p + length]).all()}
                if not found:
                    break
                best, where = length, found
            assert got[at] == best
            if best:
                assert set(index.rows[lo[at]:hi[at]].tolist()) == where
            at += 1


def brute(rows, length):
    """``rows``: (id, text hash, text)."""
    first = {}
    for i, key, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[:2]):
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            first.setdefault(tuple(w[p:p + length]), (i, key, p))
    out = []
    for i, key, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[p:p + length])] < (i, key, p):
                gone[p:p + length] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    shared = [prose(i, 70) for i in range(5)]
    texts = [None, "", " \t\n", "w " * 19, "w " * 20, "w " * 21, "w " * 90, "a b " * 40, "a b c " * 40 + "a b", "É é " * 30, "x\x1cy " * 30]
    for i in range(40):
        texts.append(prose(100 + i, rng.randint(5, 60)) + " " + rng.choice(shared) + "\n" + prose(200 + i, 30) + " " + " ".join(rng.choice(shared).split()[rng.randrange(40):]))
    whole = prose(300, 90)
    texts += [whole] * 30 + [whole + " end", "start " + whole, whole + " " + whole]
    texts += [prose(400 + i, 15) + " " + " ".join(shared[0].split()[:9]) + " " + prose(450 + i, 15) for i in range(60)]  # one common line
    texts += [prose(500, 30_000), prose(500, 30_000)[1000:60_000]]
    rows = list(enumerate(texts))
    rows += [(None, whole), (None, shared[1]), (7, texts[7]), (3, whole), (3, shared[2] + " z"), (20, texts[40])]
    rng.shuffle(rows)
    return rows


def keyed(df):
    return [tuple(r) for r in df.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)), "text").collect()]


@pytest.mark.parametrize("length, hot", [(20, places.HOT), (20, 5), (9, 12), (4, 3)])
def test_equals_brute_force(frame, length, hot):
    docs = frame(corpus()).repartition(6)
    got = S.dedup(docs, length=length, hot=hot)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    have = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()), key=repr)
    assert have == brute(keyed(docs), length)


def test_small_buckets_and_indexes(frame, monkeypatch):
    monkeypatch.setattr(places, "BUCKET_BYTES", 1 << 12)
    monkeypatch.setattr(places, "INDEX_UNITS", 300)
    monkeypatch.setattr(places, "HELD", 200)
    monkeypatch.setattr(places, "SLICE", 2_000)
    docs = frame(corpus()).repartition(3)
    got = S.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(keyed(docs), 20)


def test_edges(spark, frame):
    assert S.dedup(frame(corpus()).limit(0)).collect() == []
    assert [r["kept"] for r in S.dedup(frame([None, ""])).collect()] == ["", ""]
    clash = frame([prose(1, 60), prose(1, 60)]).selectExpr("*", "'old' AS kept", "9 AS n_words", "1 AS _spare")
    got = S.dedup(clash).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], len(r["kept"].split()), r["_spare"]) for r in got] == [(60, 0, 60, 1), (60, 60, 0, 1)]


def test_equal_windows_share_an_anchor_and_a_name():
    rng = random.Random(1)
    shared = prose(9, 45)
    texts = [(prose(20 + i, rng.randint(0, 30)) + " " + shared + " " + prose(60 + i, rng.randint(0, 30))).encode() for i in range(20)]
    s = S.segments(texts)
    by, names = {}, {}
    for k, p, n, a, name, lo, hi in zip(s.text, s.start, s.count, s.anchor, s.name, s.lo, s.hi):
        words = texts[k].split()
        assert texts[k][lo:hi].split() == words[p:p + n + 19]
        assert names.setdefault(int(name), tuple(words[p:p + n + 19])) == tuple(words[p:p + n + 19])
        for i in range(p, p + n):
            assert by.setdefault(tuple(words[i:i + 20]), a) == a
    assert sum(n for n in s.count) == sum(max(0, len(t.split()) - 19) for t in texts)
