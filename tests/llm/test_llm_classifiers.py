"""CRF, line quality, toxicity, personal data."""
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from pricewise.llm import crf, pii, quality, toxicity

from llm_texts import prose


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2])
    scores, start, step = rng.normal(size=(11, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, at = crf.viterbi(scores, lengths, start, step), 0
    for n in lengths:
        if n:
            own = scores[at:at + n]
            paths = itertools.product(range(3), repeat=int(n))
            best = max(paths, key=lambda p: start[p[0]] + sum(own[i, y] for i, y in enumerate(p))
                       + sum(step[a, b] for a, b in zip(p, p[1:])))
            assert tuple(got[at:at + n]) == best
        at += n


def test_training_learns_transitions():
    rng = np.random.default_rng(2)
    y = np.concatenate([np.repeat(rng.integers(0, 2, 6), 8) for _ in range(60)])
    x = np.stack([np.where(rng.random(len(y)) < 0.75, y, 1 - y)], axis=1).astype(float)
    model = crf.fit(x, y, np.full(60, 48), 2, rounds=100)
    got = model.decode(x, np.full(60, 48))
    assert (got == y).mean() > (x[:, 0] == y).mean() + 0.1
    assert model.step[0, 0] > model.step[0, 1] and model.step[1, 1] > model.step[1, 0]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


JUNK = "aa&&& bb%%% cc$$$ dd*** ee### ff&&& gg%%% hh$$$\n"


@pytest.fixture(scope="module")
def labelled():
    good = [prose(i, 150) for i in range(30)]
    return good, [JUNK * 12 + str(i) for i in range(30)]


def test_quality(spark, frame, labelled):
    good, bad = labelled
    docs = frame(good + bad)
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(None, 1, 0), (7, None, 0), (999, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    texts = [None, "", " \x0b ", "a b c", prose(99, 300), prose(98, 200) + "\n" + JUNK * 60, "x y z " * 50, "é ü ß " * 60,
             prose(5, 60) + "\n" + prose(5, 60), prose(97, 40_000), JUNK * 20]
    got = {r["doc_id"]: r for r in quality.score(frame(texts + [prose(99, 300)]).withColumnRenamed("lang", "kept"), model).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(t), i
    assert got[4]["kept"] and got[9]["kept"] and not got[10]["kept"] and not got[3]["kept"] and not got[5]["kept"]
    assert got[4]["content_share"] == 1.0
    empty = quality.train(docs, labels.limit(0))
    assert quality.score(frame([prose(99, 300)]), empty).first()["kept"]
    assert quality.score(docs.limit(0), model).collect() == []


def test_factorization_machine_learns_a_pair():
    """Toxic only where an insult meets a group: no additive weight can say that."""
    rng = random.Random(4)
    texts, y = [], []
    for i in range(800):
        words = prose(i % 50, 30).split() + ([] if i % 4 < 2 else ["insult"]) + ([] if i % 2 else ["group"])
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        y.append(float("insult" in words and "group" in words))
    y = np.array(y)
    model = toxicity.fit(texts[:600], y[:600])
    s = toxicity.scores(texts[600:], model, model.rows())
    assert (((s >= toxicity.CUT) == (y[600:] == 1)).mean()) > 0.97


def test_toxicity_operator(spark, frame):
    docs = frame([prose(i, 80) + (" you vileword" if i % 3 == 0 else "") for i in range(300)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).select("doc_id", "score", "predicted", toxicity.held_out().alias("held_out")).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) == int(r["score"] >= 0.3) for r in rows)
    assert 30 < sum(r["held_out"] for r in rows) < 130
    # labels of held-out rows change nothing
    from pyspark.sql import functions as F
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, other)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}
    edge = toxicity.score(frame([None, "", "vileword", "VILEWORD! " * 9000]), model).collect()
    assert [r["predicted"] for r in sorted(edge, key=lambda r: r["doc_id"])] == [0, 0, 1, 1]
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score(docs.limit(3), None).first()["score"] == 0.0


def plain_spans(text):
    """The base patterns as they are written in the contract."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_against_the_patterns():
    rng = random.Random(8)
    alphabet = ["1", "25", "255", "300", "0", ".", ".", "-", " ", "@", "a", "b.c", "+", "+1", "(", ")", "4111111111111111", "x_y", "%", "é", "\n",
                "10.0.0.1", "a@b.co", "+44 20 7946 0958"]
    for _ in range(20_000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == plain_spans(t), repr(t)


def test_crf_finds_more_and_leaves_prose_alone():
    tagger = pii.Tagger(pii.train())
    wrong = 0
    for line, spans in pii.LABELLED:
        _, every = pii.find([line], tagger)
        wrong += {line[a:b] for _, a, b in every[0]} < {p for _, p in spans}
    assert wrong <= 1
    held_out = ['the token = "aa11bb22cc33dd44ee55ff6600112233445566aa" stands', "pay 4929 1234 5678 9012 today", prose(3, 200)]
    _, every = pii.find(held_out, tagger)
    assert [s[0] for s in every[0]] == ["secret"] and [s[0] for s in every[1]] == ["card"] and every[2] == []
    assert tagger.quiet
    loud = pii.Tagger(pii.train())
    loud.quiet = False  # every line decoded: the same spans
    texts = ["\n".join([prose(i, 30), line, prose(i + 1, 20)]) for i, (line, _) in enumerate(pii.LABELLED)]
    assert pii.find(texts, loud) == pii.find(texts, tagger)


def test_pii_operators(spark, frame):
    texts = [None, "", "ä mail a.b@c.de and 10.0.0.1", "no data", "z " * 60_000 + "+1 (017) 555-7713"]
    rows = {r["doc_id"]: r for r in pii.detect(frame(texts).withColumnRenamed("lang", "spans")).collect()}
    assert rows[2]["spans"] == "email:7:15,ip:20:28" and rows[2]["n_email"] == 1 and rows[4]["spans"] == "phone:120000:120017"
    import hashlib
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r for r in pii.redact(frame(texts)).collect()}
    assert clean[0]["text"] is None and clean[0]["n_chars"] is None and clean[3]["text"] == "no data"
    assert clean[2]["text"] == "ä mail <EMAIL> and <IP>" and clean[2]["n_chars"] == 23
    assert pii.detect(frame(texts).limit(0)).collect() == []
