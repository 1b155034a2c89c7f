"""Registered queries and the pipeline over a small folder of tables."""
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from llm_texts import prose
from test_llm_joins import ITEMS, brute_components, edited

import __spark_entry__ as entry
import corpus_pipeline
from pricewise.llm import bpe, decontaminate, pii, quality
from pricewise.session import scratch_path

JUNK = "aa&&& bb%%% cc$$$ dd*** ee### ff&&& gg%%% hh$$$\n"


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(5)
    good = [prose(i, 120 + i) for i in range(40)]
    texts = good + [edited(good[i], rng, 1) for i in range(10)] + [good[3], good[4]]
    texts += [JUNK * 15 + str(i) for i in range(25)] + [None, "", "too short"]
    texts += [prose(200 + i, 80) + "\n" + ITEMS[i][1] for i in range(5)]
    texts += [prose(300 + i, 90) + f" call +1 (017) 555-77{i:02d} or write to a{i}@mail.example.org" for i in range(5)]
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[7], (None, good[9], "en", "s", len(good[9])), (None, prose(401, 100), None, None, None)]
    path = scratch_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 52), int(i % 9 == 0)) for i in range(77)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def brute(spark, path, rows):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    kept = quality.judge([(r[1] or "").encode() for r in rows], model)["kept"]
    rows = [r for r, k in zip(rows, kept) if k]
    named = [r for r in rows if r[0] is not None]
    order = sorted(set((r[0], r[1]) for r in named))
    comp = {i: c for (i, _), (_, _, c) in zip(order, brute_components(order, 5, 80))}
    seen, left = set(), []
    for r in rows:
        if (r[0] is None or comp[r[0]] == r[0]) and (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            left.append(r)
    index = decontaminate.build(ITEMS)
    left = [r for r, f in zip(left, decontaminate.search([r[1].encode() for r in left], index)) if not f]
    _, spans = pii.find([r[1] for r in left], pii.Tagger(pii.train()))
    encoder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for r, s in zip(left, spans):
        text = pii.masked(r[1], s)
        ids = encoder.encode_ordinary(text)
        out.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_pipeline_equals_brute_force(spark, folder):
    path, rows = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = brute(spark, path, rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    ids = {w[0] for w in want}
    assert {0, 1, 2} <= ids and not ids & set(range(40, 77)) and not ids & {80, 81, 82, 83, 84}


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), path).collect() == [], name


def test_near_duplicates_judge_rows_and_keep_those_without_id(spark, frame):
    base, other = prose(1, 100), prose(2, 100)
    near = edited(base, random.Random(1), 1)
    rows = [(2, base), (5, near), (5, other), (5, other), (None, base), (None, base), (None, None)]
    left = corpus_pipeline.near_duplicates(spark, frame(rows), "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted(
        [(2, base), (5, other), (None, base), (None, base), (None, None)], key=repr)


CONTRACT = {
    "op2": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "held_out", "score", "predicted"],
    "op6": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8": ["doc_id", "n_shingles", "component_id"],
    "op10": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
}


def test_registered_queries(spark, folder):
    path, rows = folder
    queries = entry.queries()
    assert {k.split("_")[0] for k in queries if k.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in queries
    for name, columns in CONTRACT.items():
        key = next(k for k in queries if k.split("_")[0] == name)
        out = queries[key](spark, path)
        assert set(columns) <= set(out.columns), key
        assert out.count() == len(rows), key
    leaks = queries["op1_decontamination"](spark, path).collect()
    assert {(r["doc_id"], r["item_id"]) for r in leaks} == {(80 + i, i) for i in range(5)}
