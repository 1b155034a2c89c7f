"""Byte-level BPE against the tiktoken library."""
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from pricewise.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = ["'s", "'re", "'ll", "s", "re", "d", "m", " ", "  ", "\n", "\t", " ", "　", "a", "É", "ß", "7", "٣", "²", "!", "?!", "-",
                "́", "漢", "\U0001F600", "'", "''", "x", "\x1c", "\x85", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [
        "", " ", "a" * 3000 + " " * 500, "ab" * 900 + "\n", "it's we'll they'd I'm 'select 'Tis '"]


def test_pieces_and_ids_match_the_library(library):
    codec = bpe.Codec(RANKS)
    given = texts()
    for t, (pieces, offsets) in zip(given, bpe.split(given)):
        ids = codec.encode(pieces).tolist()
        assert ids == library.encode_ordinary(t), repr(t)
        assert b"".join(pieces).decode() == t
        assert offsets.tolist() == [sum(map(len, pieces[:k])) for k in range(len(pieces))]
        assert codec.decode(ids) == t.encode()


def test_every_code_point_has_the_class_of_the_library(library):
    codec = bpe.Codec(RANKS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    given = ["".join(f"a{c}'s 1{c}1 !{c}" for c in points[i:i + 500]) for i in range(0, len(points), 500)]
    for i, (t, (pieces, _)) in enumerate(zip(given, bpe.split(given))):
        assert codec.encode(pieces).tolist() == library.encode_ordinary(t), hex(500 * i)


def test_monoid_scan_equals_a_plain_walk():
    import numpy as np
    m = bpe._monoid()
    f = np.random.default_rng(3).integers(0, 2 * bpe.N_CLASSES, 10_000).astype(np.uint16)
    state, want = bpe.NONE, []
    for x in f.tolist():
        want.append(state)
        state = bpe._step(bpe.NONE if x >= bpe.N_CLASSES else state, x % bpe.N_CLASSES)[0]
    assert m.states_before(f).tolist() == want


def test_long_and_short_merge_agree():
    ranks = bpe.read_ranks(RANKS)
    rng = random.Random(1)
    for _ in range(200):
        piece = bytes(rng.choice(b"abcdethinor \xc3\xa9") for _ in range(rng.randint(2, 40)))
        want = bpe._merge_short(piece, ranks)
        old, bpe.SHORT_PIECE = bpe.SHORT_PIECE, 0
        try:
            assert ranks.get(piece) is not None or bpe.merge(piece, ranks) == want
        finally:
            bpe.SHORT_PIECE = old


def test_operators(spark, frame, library):
    given = [None, "", "it's a test", "漢字 and\n\n  more", "x" * 50_000]
    docs = frame(list(enumerate(given)) + [(None, "it's a test"), (2, "it's a test")]).withColumnRenamed("lang", "ids")
    want = {t: library.encode_ordinary(t or "") for t in given}
    for r in bpe.round_trip(docs, RANKS).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r["text"]
        assert r["n_tokens"] == len(want[t])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want[t])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs, RANKS)
    back = bpe.decode(encoded, RANKS)
    assert sorted(bytes(r["data"]).decode() for r in back.collect()) == sorted(t or "" for t in given + ["it's a test"] * 2)
    assert bpe.round_trip(docs.limit(0), RANKS).collect() == []
