"""Collocations against plain counting."""
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_texts import prose

from pricewise.llm import collocations as C
from pricewise.llm.words import words_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support, most):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                own.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        n, found = total[lang], []
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= support}
        for p, a in frequent.items():
            score, _, left, right = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in frequent.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    rows = [(None, None), ("en", ""), ("en", "  \t "), ("en", "a " * 300), ("de", "É é Straße ... straße, STRASSE! a\x0bb\x0cc\x00d"), ("und", "a b c d e"), (None, "a b c d e")]
    rows += [(rng.choice(["en", "de", "fr", None]), prose(i, rng.randint(1, 400), words=60)) for i in range(80)]
    shared = prose(500, 40)
    rows += [("en", prose(600 + i, 5) + " " + shared.upper()) for i in range(40)]
    rows += [("en", prose(900, 60, words=12))] * 25  # copies
    rows.append(("fr", prose(7, 20_000, words=80)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("support, most, shard", [(10, 50, 2_000), (25, 2000, 30_000), (3, 40, 1 << 20)])
def test_equals_plain_counting(spark, support, most, shard):
    rows = corpus()
    got = C.collocations(frame(spark, rows).repartition(7), support, most, shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, support, most)


def test_edges(spark):
    assert C.collocations(frame(spark, corpus()).limit(0)).collect() == []
    assert C.collocations(frame(spark, [(None, None), ("en", "")])).collect() == []
    extra = frame(spark, [("en", "x y " * 60)]).selectExpr("*", "1 AS n", "2 AS phrase", "3 AS size")
    assert sorted(tuple(r) for r in C.collocations(extra, 20).collect()) == plain([("en", "x y " * 60)], 20, C.TOP)


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000
    rows = [("en", 0, "", 9 * 10 ** 17), ("en", 1, "p", big), ("en", 1, "q", big + 1), ("en", 2, "p q", big - 7)]
    got = C.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()
    assert [r["score"] for r in got] == [1000 * (big - 7) * 9 * 10 ** 17 // (big * (big + 1))]


def test_words_are_found_and_told_apart():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab \t\n.é") for _ in range(rng.randint(0, 60))).encode() for _ in range(300)]
    w = words_of(texts, C._TABLE)
    seen, by_hash, at = [], {}, 0
    for k, t in enumerate(texts):
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", t):
            for j, word in enumerate(re.findall(rb"[^\x20\x09]+", piece)):
                seen.append((k, word, j == 0))
                assert by_hash.setdefault(int(w.hash[at]), word) == word
                at += 1
    assert len(set(by_hash.values())) == len(by_hash)
    got = [(int(k), w.data[a:b].tobytes()) for k, a, b in zip(w.text, w.start, w.end)]
    assert got == [(k, word) for k, word, _ in seen]
    new = [i for i, (k, _, first) in enumerate(seen) if first]
    assert set(np.flatnonzero(w.new)) == set(new)


def test_long_texts_are_cut_where_a_piece_ends():
    text = ("w1 w2 w3 w4. " * 200).encode()
    parts = list(C._cut(text, 100))
    assert b"".join(parts) == text and all(p.endswith(b".") for p in parts[:-1])
    assert list(C._cut(b"x" * 500, 100))[0] == b"x" * 500
