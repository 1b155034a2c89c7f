"""No text of any length or alphabet stops an operator."""
import random

import public_tokenizers as P
import pytest
from llm_texts import prose

from pricewise.llm import bpe, collocations, decontaminate, jaccard, licenses, pii, quality, repeats, substrings, token_counts, token_store, toxicity
from pricewise.session import scratch_path

RANKS = P.path("byte_bpe_50k.tiktoken")


def runs():
    """Long runs of every class of characters, and mixtures of them."""
    long = 6000
    texts = [c * long for c in "0 1 9 a Z . , ; : ! ? - + @ _ % ( ) # < > | é 漢 Ᲊ \U0001F600 ́   \x00 \x1c \x85".split(" ")]
    texts += [c * long for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c", "\r\n")]
    texts += ["0" * 5000 + ".1.1.1", "1.0." + "0" * 5000 + ".255", "1." * long, "+" + "1" * long, "+1 " * long, "4 " * long, "4-" * long, "a@" * long, "a@b." * long, "@" * long + "x",
              "mit license " * 900, "https://a.b/" * 900, "x" * 20_000 + " y", "a b " * long]
    rng = random.Random(1)
    texts += ["".join(rng.choice("01 .@+-a\n#é漢́") for _ in range(3000)) for _ in range(10)]
    return texts + [None, "", " "]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(runs() + [prose(i, 80) for i in range(30)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    n = len(rows)
    labels = spark.createDataFrame([(n - 1 - i, i % 2, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(i, prose(900 + i, 30)) for i in range(5)] + [(9, "0" * 3000), (10, "漢" * 3000), (11, None)], "item_id long, text string")
    return docs, labels, items


def stored(spark, docs):
    out = scratch_path(spark, "fuzz")
    token_store.write(docs, out, P.path("byte_bpe_50k.json"))
    return token_store.checksums(spark, out)


OPERATORS = {
    "decontaminate": lambda spark, docs, labels, items: decontaminate.leaks(docs, items),
    "token_store": lambda spark, docs, labels, items: stored(spark, docs),
    "licenses": lambda spark, docs, labels, items: licenses.digest(licenses.scan(docs)),
    "quality": lambda spark, docs, labels, items: quality.score(docs, quality.train(docs, labels)),
    "toxicity": lambda spark, docs, labels, items: toxicity.score(docs, toxicity.train(docs, labels)),
    "pii": lambda spark, docs, labels, items: pii.detect(docs),
    "redact": lambda spark, docs, labels, items: pii.redact(docs),
    "bpe": lambda spark, docs, labels, items: bpe.round_trip(docs, RANKS),
    "jaccard": lambda spark, docs, labels, items: jaccard.cluster(docs, 4, 85),
    "counts": lambda spark, docs, labels, items: token_counts.answers(token_counts.histogram(docs.select("text"), RANKS, P.PATTERN)),
    "repeats": lambda spark, docs, labels, items: repeats.dedup(docs),
    "substrings": lambda spark, docs, labels, items: substrings.dedup(docs),
    "collocations": lambda spark, docs, labels, items: collocations.collocations(docs, support=20),
}
PER_DOCUMENT = {"token_store", "quality", "toxicity", "pii", "redact", "bpe", "jaccard", "repeats", "substrings"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_long_runs_of_every_class(spark, tables, name):
    got = OPERATORS[name](spark, *tables).collect()
    if name in PER_DOCUMENT:
        assert sorted(r["doc_id"] for r in got) == list(range(tables[0].count()))


def test_ip_parts_with_leading_zeros():
    assert [s[0] for s in pii.base_spans("0" * 5000 + ".1.1.1")] == ["ip"]
    assert [s[0] for s in pii.base_spans("1.2.3." + "0" * 5000 + "256")] == []
    for part, ok in (("255", True), ("256", False), ("0256", False), ("0255", True), ("000", True), ("99", True), ("1000", False)):
        assert [s[0] for s in pii.base_spans(f"{part}.1.1.1")] == ["ip"] * ok
