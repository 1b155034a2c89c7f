"""Token store and token counts."""
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from pricewise.llm import bpe, token_counts, token_store as S
from pricewise.session import scratch_path

from llm_texts import prose

JSON = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("ids", [[], [5], [2] * 5000, list(range(9000)), [65535, 0] * 3000])
def test_pack_round_trip(ids):
    ids = np.array(ids, dtype=np.int64)
    assert np.array_equal(S.unpack(S.pack(ids)), ids)


def test_random_and_regular_ids():
    rng = np.random.default_rng(0)
    noise = rng.integers(0, 65536, 12_000)
    assert np.array_equal(S.unpack(S.pack(noise)), noise)
    regular = np.tile(rng.integers(0, 50_000, 50), 200)
    packed = S.pack(regular)
    assert np.array_equal(S.unpack(packed), regular)
    assert len(packed) * 8 / len(regular) < 2  # predicted ids cost little


def test_damage_is_found_and_stays_in_its_block():
    ids = np.arange(3 * S.BLOCK_TOKENS) % 700
    packed = bytearray(S.pack(ids))
    packed[-20] ^= 255
    with pytest.raises(ValueError):
        S.unpack(bytes(packed))
    with pytest.raises(ValueError):
        S.pack(np.array([70_000]))


def test_segments_are_coded_in_step(monkeypatch):
    rng = np.random.default_rng(1)
    segments = [rng.zipf(1.3, n) % 50_000 for n in (5000, 0, 1, 4096, 300, 9000, 700)]
    steps, step = [], S._Model.step
    monkeypatch.setattr(S._Model, "step", lambda self, *a: steps.append(1) or step(self, *a))
    packed = S.pack_all(segments)
    assert len(steps) == S.BLOCK_TOKENS  # not so many for each segment
    assert packed == [S.pack(s) for s in segments]
    steps.clear()
    assert all(np.array_equal(a, b) for a, b in zip(S.unpack_all(packed), segments, strict=True))
    assert len(steps) == S.BLOCK_TOKENS
    monkeypatch.setattr(S, "LANES", 3)  # in several groups
    assert S.pack_all(segments) == packed
    assert all(np.array_equal(a, b) for a, b in zip(S.unpack_all(packed), segments, strict=True))


def test_bytes_of_the_format_stay():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.zipf(1.2, 9000) % 50_000, np.arange(9000) % 13, rng.integers(0, 65536, 3000)])
    packed = S.pack(ids)
    assert (len(packed), zlib.crc32(packed)) == (18650, 2597286291)  # files written before stay readable
    for at in rng.integers(0, len(packed) - 100, 3).tolist():  # damage in a block is a ValueError, whatever it does to the model
        hurt = bytearray(packed)
        hurt[100 + at] ^= 1 << at % 8
        with pytest.raises(ValueError):
            S.unpack(bytes(hurt))


def test_store_in_many_small_segments(spark, frame, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_TOKENS", 200)
    monkeypatch.setattr(S, "LANES", 1)
    texts = [(i // 2, prose(i % 11, 40 + i)) for i in range(60)] + [(None, None), (7, "")]
    out = scratch_path(spark, "store-small")
    S.write(frame(texts).coalesce(1), out, JSON)
    library = Tokenizer.from_file(JSON)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [S.END_ID] for _, t in order]
    got = sorted((tuple(r) for r in S.read(spark, out).collect()), key=lambda r: r[1])
    assert [(i, r) for i, _, _, r in got] == [(i, r) for (i, _), r in zip(order, ids)]
    assert [r[1] for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    assert spark.read.parquet(out).count() > 10


def test_store(spark, frame, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_TOKENS", 3000)
    texts = [(7, "it's <|endoftext|> here"), (3, None), (None, "no id"), (5, prose(1, 5000)), (5, prose(1, 5000)), (1, ""), (9, "ünï\n\n x")]
    texts += [(100 - i, prose(i, 300)) for i in range(30)]
    texts += [(200, "\u1c89's and <|endoftext|><|endoftext|> \U00010d40's")]
    library = Tokenizer.from_file(JSON)  # as its file says
    out = scratch_path(spark, "store")
    S.write(frame(texts), out, JSON)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, at = [], 0
    for i, t in order:
        ids = library.encode(t or "", add_special_tokens=False).ids + [S.END_ID]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    got = sorted((tuple(r) for r in S.read(spark, out).collect()), key=lambda r: r[1])
    assert got == want
    assert 50256 in dict((w[0], w[3]) for w in want)[200]  # whole texts: the library sees its special token
    sums = sorted(S.checksums(spark, out).collect(), key=lambda r: r["start"])
    assert [r["ids_crc32"] for r in sums] == [zlib.crc32(np.array(w[3], "<u4").tobytes()) for w in want]
    empty = scratch_path(spark, "store-empty")
    S.write(frame(texts).limit(0), empty, JSON)
    assert S.read(spark, empty).collect() == []


def test_counts(spark, frame):
    texts = [None, "", "one", "one"] + [prose(i, 40 * i) for i in range(40)]
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    n = [len(encoder.encode_ordinary(t or "")) for t in texts]
    hist = token_counts.histogram(frame(texts), RANKS, P.PATTERN)
    rows = token_counts.answers(hist).collect()
    assert sorted(r["context_limit"] for r in rows) == sorted(set(n))
    for r in rows:
        c = r["context_limit"]
        assert (r["n_docs"], r["n_longer"], r["tokens_total"], r["tokens_kept"]) == (
            n.count(c), sum(x > c for x in n), sum(n), sum(min(x, c) for x in n))
        assert r["tokens_cut"] == sum(n) - r["tokens_kept"] and r["share_fitting"] == sum(x <= c for x in n) / len(n)
    limits, quantiles = (1, 7, 64, n[9]), (0.0, 0.1, 0.5, 0.9, 1.0)
    rows = {r["context_limit"]: r for r in token_counts.answers(hist, limits, quantiles).collect()}
    assert set(rows) == set(n) | set(limits)
    for c, r in rows.items():
        assert (r["n_docs"], r["n_longer"], r["tokens_kept"]) == (n.count(c), sum(x > c for x in n), sum(min(x, c) for x in n))
    for q in quantiles[1:]:
        want = next(x for x in sorted(n) if sum(y <= x for y in n) / len(n) >= q)
        assert [c for c, r in rows.items() if f"{q:g}" in r["quantiles"].split(",")] == [want]
    assert token_counts.answers(hist.limit(0), limits, quantiles).collect() == []
    assert token_counts.quantile(hist, 0.5).first()[0] == sorted(n)[len(n) // 2 - 1]
    assert token_counts.answers(token_counts.histogram(frame(texts).limit(0), RANKS, P.PATTERN)).collect() == []
