"""Quality rules: line labelling by a linear-chain CRF.

Each text is a sequence of lines. Binary line features (symbols, capitals,
table bars, repeats, length, punctuation) feed a CRF with the labels content
and boilerplate; Viterbi decoding marks every line. The share of a text's word
characters that stand in content lines decides whether it is kept. Two base
rules reject a text before that: too few words, too many repeated words.

Training: lines of a bounded sample of documents with a quality label take the
label of their document (``SAMPLE_DOCS`` documents per label, texts up to
``SAMPLE_CHARS`` characters). Ordinary lines occur in far more good documents
than bad ones, so they become content. Without labels every line is content.

Words are runs of bytes other than ASCII white space. Null texts have no words.
Repeated rows and ids, null ids and further columns pass through: one output row
per input row, added columns replace equal names.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import bound_batches, slices, texts_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
KEEP_SHARE = 0.5
SAMPLE_DOCS = 700
SAMPLE_CHARS = 20_000
CONTENT, BOILERPLATE = 0, 1

FEATURES = ["many symbols", "some symbols", "mostly capitals", "bars", "repeated line", "few distinct words",
            "very few distinct words", "short", "long", "ends a sentence", "starts with a capital", "digits",
            "exclamations", "first line", "no letters"]

ADDED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
         ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
         ("n_lines", T.LongType()), ("content_share", T.DoubleType()), ("kept", T.BooleanType())]


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    hit = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=len(windows))
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k:len(words) - 2 + k] |= hit
    return int(covered.sum())


def line_features(line: bytes, words: list[bytes], repeated: bool, first: bool) -> list[bool]:
    size = len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    capitals = size - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    small = size - len(line.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    digits = size - len(line.translate(None, b"0123456789"))
    n, kinds = len(words), len(set(words))
    return [symbols * 10 > size, symbols > 1, capitals > small, line.count(b"|") > 2, repeated,
            n > 5 and kinds * 2 < n, n > 5 and kinds * 5 < n, n < 4, n > 40, line.rstrip()[-1:] in b".?!:",
            line.lstrip()[:1].isupper(), digits * 4 > size, line.count(b"!") > 2, first, capitals + small == 0]


def read_lines(text: bytes) -> tuple[list[list[bool]], list[int], int]:
    """Features and word characters (bytes) of each line with a word; lines equal to an earlier one."""
    rows, weight, seen, repeats = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        known = line in seen
        if known:
            repeats += 1
        else:
            seen.add(line)
        rows.append(line_features(line, words, known, not rows))
        weight.append(sum(map(len, words)))
    return rows, weight, repeats


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS) -> crf.CRF:
    """Fit on a bounded sample: ``sample`` labelled documents of each quality,
    those with the smallest hash of their id."""
    ids = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").distinct()
    picked = []
    for q in (0, 1):
        picked += [(r["doc_id"], q) for r in ids.where(F.col("quality") == q)
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    quality = dict(picked)
    rows = (docs.where(F.col("doc_id").isin(list(quality)) & (F.length(text_col) <= SAMPLE_CHARS))
            .select("doc_id", text_col).collect()) if quality else []
    x, y, lengths = [], [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"], r[text_col])):
        lines, _, _ = read_lines(r[text_col].encode("utf-8", "replace"))
        x += lines
        y += [BOILERPLATE if quality[r["doc_id"]] == 0 else CONTENT] * len(lines)
        lengths.append(len(lines))
    if not x or len(set(y)) < 2:
        return crf.CRF(np.zeros((len(FEATURES), 2)), np.array([1.0, 0.0]), np.zeros(2), np.zeros((2, 2)))
    return crf.fit(np.array(x, dtype=float), np.array(y), np.array(lengths), 2, rounds=80)


def judge(texts: list[bytes], model: crf.CRF) -> dict[str, list]:
    """The added columns for some texts."""
    out: dict[str, list] = {k: [] for k, _ in ADDED}
    rows, weights, lengths = [], [], []
    for text in texts:
        words = text.split()
        n = len(words)
        # code points are the bytes that don't continue another
        joined = b"".join(words)
        chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
        lines, weight, repeats = read_lines(text)
        again = repeated_words(words)
        out["n_words"].append(n)
        out["word_chars"].append(chars)
        out["n_symbols"].append(len(text) - len(text.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(repeats)
        out["n_repeat_words"].append(again)
        out["base_failed"].append(n < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * n)
        out["n_lines"].append(len(lines))
        rows += lines
        weights += weight
        lengths.append(len(lines))
    lengths = np.array(lengths, dtype=np.int64)
    x = np.array(rows, dtype=float).reshape(len(rows), len(FEATURES))
    content = np.array(weights, dtype=float) * (model.decode(x, lengths) == CONTENT)
    ends = np.cumsum(lengths)
    run, all_run = np.append(0, np.cumsum(content)), np.append(0, np.cumsum(weights))
    total = all_run[ends] - all_run[ends - lengths]
    share = (run[ends] - run[ends - lengths]) / np.maximum(total, 1)
    out["content_share"] = np.where(total > 0, share, 0.0).tolist()
    out["kept"] = [not f and s >= KEEP_SHARE for f, s in zip(out["base_failed"], out["content_share"])]
    return out


def score(docs: DataFrame, model: crf.CRF, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the columns of ``ADDED``; rejected rows stay, marked."""
    bound_batches(docs.sparkSession)
    added = [n for n, _ in ADDED]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in ADDED])
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                new = judge(texts_bytes(part, text_col), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(new[n]) for n in added], names=names + added)

    return docs.mapInArrow(run, schema)
