"""Jaccard join, long repeats, decontamination against brute force."""
import hashlib
import random

import numpy as np
import pytest

from pricewise.llm import decontaminate as D
from pricewise.llm import jaccard as J
from pricewise.llm import places
from pricewise.llm import repeats as R

from llm_texts import prose


def edited(text, rng, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(11)
    texts = [None, "", "  ", "one", "one two", "one two", "ONE  two", "one two three four"]
    for i in range(12):
        base = prose(i, rng.randint(8, 300))
        texts += [base, base] + [edited(base, rng, e) for e in (1, 1, 2, 3, 6)]
    chain = prose(77, 300)
    for _ in range(12):  # neighbours link, far ones don't
        chain = edited(chain, rng, 4)
        texts.append(chain)
    shared = prose(500, 60)
    texts += [prose(600 + i, 25) + " " + shared for i in range(30)]  # a passage that many have
    hot = prose(900, 200)
    texts += [edited(hot, rng, 1) for _ in range(60)] + [hot] * 20
    texts.append(prose(3, 20_000))
    return list(enumerate(texts))


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
        n = min(size, len(w))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [(rows[i][0], len(sets[i]), rows[top(i)][0]) for i in range(len(rows))]


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 60)])
def test_components_match_brute_force(frame, size, percent):
    rows = corpus()
    got = sorted(tuple(r) for r in J.cluster(frame(rows), size, percent).collect())
    assert got == sorted(brute_components(rows, size, percent))


def test_frequent_tokens_use_pairs_and_lose_nothing():
    """Any two sets beyond the threshold share a signature, whatever the levels."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(6, 120))
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        table = {int(x): int(v) for x, v in zip(base, rng.integers(0, 4, len(base)) * (rng.random() < 0.8))}
        other = np.unique(np.append(base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)))
        for x in other:
            table.setdefault(int(x), int(rng.integers(0, 4)))
        both = len(np.intersect1d(base, other))
        union = len(base) + len(other) - both
        if 100 * both >= 80 * union and union > both:
            a, b = (J.signatures(s, np.array([table[int(x)] for x in s]), 80) for s in (base, other))
            assert len(np.intersect1d(a, b)), (len(base), len(other), both)


def test_jaccard_edges(spark, frame):
    text = prose(1, 80)
    rows = [(None, text), (5, text), (5, text), (9, text.upper()), (2, None), (None, None)]
    got = sorted((tuple(r) for r in J.cluster(frame(rows), 4, 85).collect()), key=repr)
    n = len({tuple(text.split()[i:i + 4]) for i in range(77)})
    assert got == sorted([(None, n, 5), (5, n, 5), (5, n, 5), (9, n, 5), (2, 0, 2), (None, 0, None)], key=repr)
    assert J.cluster(frame(rows).limit(0), 4, 85).collect() == []


def brute_repeats(rows, length):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p:p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p:p + length]] < i:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeated_corpus():
    rng = random.Random(3)
    shared = [prose(i, 14) for i in range(6)]
    rows = [None, "", "a" * 49, "a" * 50, "a" * 120, "b" + "a" * 70, "é" * 60, "ab" * 80, "ab" * 81 + "é" * 40]
    for i in range(40):
        rows.append(prose(100 + i, rng.randint(5, 60)) + rng.choice(shared) + prose(200 + i, 30) + rng.choice(shared)[rng.randrange(20):])
    whole = prose(300, 90)
    rows += [whole, whole, whole + "x", "y" + whole, whole[40:], edited(whole, rng, 2), prose(100, 3000), prose(100, 3000)[5:4000]]
    return list(enumerate(rows)) + [(None, whole), (12, prose(100 + 12, 40) + shared[0]), (30, whole)]


@pytest.mark.parametrize("hot", [10**9, 0])
def test_repeats_match_brute_force(frame, monkeypatch, hot):
    from pyspark.sql import functions as F
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "INDEX_BYTES", 3000)
    rows = repeated_corpus()
    docs = frame(rows)
    got = R.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(rows, R.LENGTH)
    assert R.dedup(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot", [3, 12])
def test_no_group_of_places_outgrows_the_bound(spark, frame, monkeypatch, hot):
    """Places of a passage that most documents have do not meet in one task."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(R, "HOT", hot)
    rows = repeated_corpus()
    shared = prose(910, 40)
    rows += [(1000 - i, prose(950 + i, 20) + shared + prose(950 + i % 7, 30)) for i in range(45)]
    docs = frame(rows)
    search = places.Search(docs, R.method(), hot=hot)
    firsts = search.firsts(spark.sparkContext.broadcast(search.anchors()))
    groups = {}
    for r in firsts.collect():
        d = places._array(r["data"], places._FIRST)
        assert len(np.unique(d["name"])) == len(d)  # copies are one entry
        for a in d["anchor"].tolist():
            groups[r["bucket"], a] = groups.get((r["bucket"], a), 0) + 1
    assert groups and max(groups.values()) <= hot
    got = R.dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(rows, R.LENGTH)


def test_matching_statistics_against_brute_force():
    rng = random.Random(9)
    strings = ["".join(rng.choice("aab") for _ in range(rng.randint(1, 60))).encode() for _ in range(25)]
    index = R.RunLengthIndex(strings, np.arange(25), 9)
    patterns = ["".join(rng.choice("aaabbc") for _ in range(rng.randint(1, 30))).encode() for _ in range(40)] + strings
    size = np.array([len(p) for p in patterns])
    begin = np.cumsum(size) - size
    length, row, place = index.statistics(np.frombuffer(b"".join(patterns), np.uint8), begin, size)
    for b, p in zip(begin.tolist(), patterns):
        for i in range(len(p)):
            want = max(n for n in range(len(p) - i + 1) if n == 0 or any(p[i:i + n] in s for s in strings))
            n, at = int(length[b + i]), int(place[b + i])
            assert n == want
            assert bytes((index.sym[at:at + n] - 1).astype(np.uint8)) == p[i:i + n]
            if n >= 9:
                docs = [k for k, s in enumerate(strings) if p[i:i + 9] in s]
                assert index.first_documents(row[b + i:b + i + 1])[0] == docs[0]
    runs = 1 + sum(a != b for a, b in zip(index.run_sym, index.run_sym[1:]))
    assert runs == len(index.run_sym) < index.rows


ITEMS = [(i, prose(1000 + i, 12 + i % 50, 4000) + ". " + prose(2000 + i, 5 + i % 7, 4000) + ".") for i in range(60)]


def brute_scores(words, index):
    return {k: sum(s for t, s in own.items() if t in words) for k, own in enumerate(index.impact)}


def test_wand_retrieves_all_above_the_threshold(monkeypatch):
    index = D.build(ITEMS)
    rng = random.Random(2)
    texts = [prose(i, 300, 4000) for i in range(20)]
    for i in range(40):
        w = ITEMS[i][1].split()
        keep = [x for x in w if rng.random() < 0.4 + 0.6 * (i % 4) / 3]
        texts.append(prose(50 + i, rng.randint(0, 200), 4000) + " " + " ".join(keep) + " " + prose(90 + i, 30, 4000))
    monkeypatch.setattr(D, "DENSE", 400)
    found = D.search([t.encode() for t in texts], index, threshold=0.5, overlap=0.0)
    m = index.longest
    for t, f in zip(texts, found):
        w = D.words_of(t.encode())
        best = {}
        for c in range(max(1, -(-len(w) // m))):
            for k, s in brute_scores(set(w[c * m:(c + 2) * m]), index).items():
                best[k] = max(best.get(k, 0.0), s)
        assert {k: round(v[0], 9) for k, v in f.items()} == {k: round(s, 9) for k, s in best.items() if s >= 0.5}


def test_planted_items(spark, frame):
    items = spark.createDataFrame(ITEMS + [(900, None), (901, "")], "item_id long, text string")
    planted = {3: 7, 8: 40, 11: 59}
    texts = [prose(i, 400, 4000) for i in range(15)]
    for d, i in planted.items():
        texts[d] = texts[d][:900] + "\n" + ITEMS[i][1].upper() + "\n" + texts[d][900:]
    question = " ".join(ITEMS[20][1].split()[:-6])  # the answer is missing
    texts += [None, "", question[:0], prose(1, 40_000, 4000) + " " + ITEMS[5][1]]
    docs = frame(texts).withColumnRenamed("lang", "score")
    got = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, items).collect()}
    assert got == {*planted.items(), (18, 5)}
    left = {r["doc_id"] for r in D.clean(frame(texts), items).collect()}
    assert left == set(range(len(texts))) - set(planted) - {18}
    assert D.leaks(docs, items.limit(0)).collect() == [] == D.leaks(docs.limit(0), items).collect()


def test_answer_must_overlap():
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta. iota kappa lambda mu.")]
    index = D.build(items)
    whole = items[0][1].encode()
    assert D.search([whole], index)[0]
    assert not D.search([whole.replace(b"iota kappa lambda mu", b"other words stand here")], index, threshold=0.3)[0]


def test_short_tails_hide_no_copy():
    """A copy is found although its one-word tail, or one word anywhere, is another."""
    head = " ".join(f"w{i}" for i in range(20))
    items = [(0, head + ". er."), (1, "solitary"), (2, "m0 m1 m2 m3 m4 m5 m6 m7. n0 n1 n2 n3 n4. n5.")]
    index = D.build(items)
    at = {item: k for k, item in enumerate(index.items)}
    assert at[0] in D.search([head.encode()], index)[0]  # the tail is missing
    for i in range(21):
        words = D.words_of(items[0][1].encode())
        words[i] = b"other"
        assert at[0] in D.search([b" ".join(words)], index)[0], i
    assert at[1] in D.search([b"a solitary word"], index)[0]
    assert at[2] in D.search([b"m3 m4 m5 m6 m7 n0 n1 n2 n3 n4"], index)[0]  # half of the question and the longer answer
    assert at[2] not in D.search([b"m0 m1 m2 m3 m4 m5 m6 m7 n4"], index)[0]  # no answer
    assert not D.search([b"nothing of them stands here"], index)[0]


def test_parity_bits_never_reject_a_link(spark):
    """The bound holds for sets of very different length, folded or not."""
    rng = np.random.default_rng(6)
    sets, pairs = [], []
    for n in (3, 900, 1023, 1025, 2047, 2050, 9000):
        base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        near = np.unique(np.append(base[rng.random(len(base)) > 0.05], rng.integers(0, 1 << 62, n // 20).astype(np.uint64)))
        far = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        for s in (base, near, far):
            sets.append(s)
        k = len(sets) - 3
        pairs += [(k, k + 1), (k, k + 2)]
    marks = spark.createDataFrame([(i, len(s), [int(x) for x in J.parity(s)]) for i, s in enumerate(sets)],
                                  "node long, n_shingles long, bits array<long>")
    got = {tuple(r) for r in J.plausible(spark.createDataFrame(pairs, "a long, b long"), marks, 80).collect()}
    linked = set()
    for a, b in pairs:
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            linked.add((a, b))
    assert len(linked) >= 5 and linked <= got
    assert not {(a, b) for a, b in got if b == a + 2 and len(sets[a]) > 500}  # unrelated sets are told apart


def test_large_sets_share_a_pair():
    rng = np.random.default_rng(8)
    for n in (1000, 1030, 1400, 2040, 2100, 5000):
        for _ in range(4):
            base = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            other = np.unique(np.append(base[rng.random(len(base)) > 0.07], rng.integers(0, 1 << 62, int(n * 0.07)).astype(np.uint64)))
            both = len(np.intersect1d(base, other))
            if 100 * both >= 85 * (len(base) + len(other) - both):
                level = {int(x): int(v) for x, v in zip(np.union1d(base, other), rng.integers(0, 2, n * 3))}
                a, b = (J.signatures(s, np.array([level[int(x)] for x in s]), 85) for s in (base, other))
                assert len(np.intersect1d(a, b)), (n, both)
                assert len(a) < len(base)
