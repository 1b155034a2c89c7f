"""Benchmark decontamination: BM25 index of test items, block-max WAND, verification.

The items are the indexed side (of stated size, ``MAX_POSTINGS``), every passage
of every document is a query. A passage is a window of ``2 * m`` words that moves
by ``m``, the word count of the longest item, so a copy of an item always lies
whole in some passage. The score of a passage for an item is the BM25 sum over
their common words, divided by the item's own full score: 1 is a passage with
all its words. Retrieved is every (passage, item) with a score of ``threshold``
or more; nothing is cut to a top k.

Retrieval follows block-max WAND. Postings are in item order in blocks of
``BLOCK`` items with the largest impact per word and block. For all passages of a
slice at once, the block maxima of the essential words are added up per passage
and block, those of the few non-essential ones come from one matrix product; only
blocks whose bound reaches the threshold are scored exactly.

A retrieved item is verified by its question (all but its last sentence) and
answer (its last sentence): of both, at least ``overlap`` of the word pairs must
stand in the passage. Both parts of a one-sentence item are halves of its words. A
last sentence of less than ``MIN_ANSWER`` words need not be the answer: then it is
enough that the item split before an earlier sentence passes, so that the answer has
that many words. A passage with ``WHOLE`` of all pairs of an item holds it, whatever
part is missing. The parts of a one-word item are that word and nothing; the empty
part is always there.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered. Null
texts have none. Items without words are never found; repeated items each are.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, check_broadcast, slices, texts_bytes

K1, B = 1.2, 0.75
BLOCK = 2
#: Words of more items than this and a sixteenth of all are non-essential.
ESSENTIAL = 8
THRESHOLD = 0.5
OVERLAP = 0.5
#: Share of the word pairs of a whole item that settles it without its parts.
WHOLE = 0.8
#: Words of an answer; shorter last sentences are also tried with the ones before.
MIN_ANSWER = 4
MAX_POSTINGS = 5_000_000
#: Bound of the dense (passage, block) sums of a slice.
DENSE = 2_000_000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_SENTENCE_END = re.compile(rb"[.!?:]\s+|\n")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def question_answer(text: bytes, least: int = 1) -> tuple[list[bytes], list[bytes]]:
    """Words before and in the last sentences that have ``least`` words; halves if nothing is before."""
    ends = [m.end() for m in _SENTENCE_END.finditer(text.rstrip())]
    words = words_of(text)
    tails = [len(words_of(text[e:])) for e in ends]
    tail = max([t for t in tails if t >= least][-1:], default=0)
    if not 0 < tail < len(words):
        tail = len(words) // 2
    return words[:len(words) - tail], words[len(words) - tail:]


def _pairs(words: list[bytes]) -> set:
    return set(zip(words, words[1:])) or set(words)


@dataclass
class Index:
    items: list           # item ids, by item number
    parts: list           # (question pairs, answer pairs), of short answers also those of a longer one
    whole: list           # pairs of the item
    longest: int
    terms: dict           # word -> term number
    essential: np.ndarray  # term -> bool
    often: np.ndarray     # the other terms
    often_max: np.ndarray  # those x blocks: largest impact
    block_at: np.ndarray  # term -> first block posting, and the end
    block: np.ndarray
    block_max: np.ndarray
    impact: list          # item -> {word: impact / full score}

    @property
    def blocks(self) -> int:
        return -(-len(self.items) // BLOCK)


def build(rows: list[tuple]) -> Index:
    """Index of (item_id, text) rows."""
    rows = [(i, (t or "").encode("utf-8", "replace")) for i, t in rows]
    rows = sorted(((i, t, words_of(t)) for i, t in rows if words_of(t)), key=lambda r: (str(r[0]), r[1]))
    # items with similar words share a block: block maxima then say more
    rows.sort(key=lambda r: sorted(r[2], key=len)[-1])
    check_broadcast(sum(len(set(w)) for _, _, w in rows), MAX_POSTINGS, "benchmark postings")
    df: dict[bytes, int] = {}
    for _, _, w in rows:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    mean = sum(len(w) for _, _, w in rows) / max(len(rows), 1)
    impact, parts, whole = [], [], []
    for _, text, w in rows:
        own = {}
        for t in set(w):
            tf = w.count(t)
            idf = np.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))
            own[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
        full = sum(own.values())
        impact.append({t: float(s / full) for t, s in own.items()})
        splits = [question_answer(text)]
        if len(splits[0][1]) < MIN_ANSWER:
            splits.append(question_answer(text, MIN_ANSWER))
        parts.append([(_pairs(q), _pairs(a)) for q, a in splits])
        whole.append(_pairs(w))
    terms = {t: k for k, t in enumerate(sorted(df))}
    best: dict[tuple[int, int], float] = {}
    for k, own in enumerate(impact):
        for t, s in own.items():
            key = (terms[t], k // BLOCK)
            best[key] = max(best.get(key, 0.0), s)
    keys = sorted(best)
    at = np.searchsorted(np.array([k[0] for k in keys]), np.arange(len(terms) + 1)) if keys else np.zeros(1, int)
    essential = np.array([df[t] <= max(ESSENTIAL, len(rows) // 16) for t in sorted(df)], dtype=bool)
    often = np.flatnonzero(~essential)
    column = {int(t): k for k, t in enumerate(often)}
    often_max = np.zeros((len(often), -(-len(rows) // BLOCK)), dtype=np.float32)
    for (t, b), s in best.items():
        if t in column:
            often_max[column[t], b] = s
    return Index([i for i, _, _ in rows], parts, whole, max((len(w) for _, _, w in rows), default=1), terms, essential, often, often_max,
                 at, np.array([k[1] for k in keys], dtype=np.int64), np.array([best[k] for k in keys]), impact)


def search(texts: list[bytes], index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP):
    """Per text: {item number: (score, first word of the passage, question share, answer share)}, the best passage."""
    found: list[dict] = [{} for _ in texts]
    if not index.items:
        return found
    m = index.longest
    per = max(1, DENSE // index.blocks)
    words = [words_of(t) for t in texts]
    # chunks of m words; passage = a chunk and the next one of the same text
    chunks = [max(1, -(-len(w) // m)) for w in words]
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + chunks[hi] <= per):
            total += chunks[hi]
            hi += 1
        for k, chunk, block in _survivors(words[lo:hi], chunks[lo:hi], index, threshold):
            own = words[lo + k][chunk * m:(chunk + 2) * m]
            _score(own, chunk * m, block, index, threshold, overlap, found[lo + k])
        lo = hi
    return found


def _survivors(words, chunks, index: Index, threshold: float):
    """(text, chunk, block) whose bound reaches the threshold."""
    m, blocks = index.longest, index.blocks
    first = np.cumsum([0] + chunks)
    n = int(first[-1])
    sizes = np.full(n, m)
    sizes[first[1:] - 1] = [len(w) - (c - 1) * m for w, c in zip(words, chunks)]
    term = np.fromiter(map(index.terms.get, chain.from_iterable(words), repeat(-1)), dtype=np.int32, count=int(sizes.sum()))
    chunk = np.repeat(np.arange(n, dtype=np.int64), sizes)
    known = term >= 0
    key = chunk[known] * len(index.terms) + term[known]
    if n * len(index.terms) < 1 << 31:
        key = key.astype(np.int32)  # sorts faster
    # a word counts once in a chunk, as in the exact score
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])].astype(np.int64) if len(key) else key.astype(np.int64)
    chunk = key // max(len(index.terms), 1)
    term = key - chunk * len(index.terms)
    ess = index.essential[term]
    often = np.zeros((n, len(index.often)), dtype=np.float32)
    often[chunk[~ess], np.searchsorted(index.often, term[~ess])] = 1
    often[:-1] = np.where(np.isin(np.arange(n - 1), first[1:] - 1)[:, None], often[:-1], np.maximum(often[:-1], often[1:]))
    rest = often @ index.often_max
    term, chunk = term[ess], chunk[ess]
    count = index.block_at[term + 1] - index.block_at[term]
    begin = np.repeat(index.block_at[term] - (np.cumsum(count) - count), count)
    post = begin + np.arange(len(begin))
    sums = np.bincount(np.repeat(chunk, count) * blocks + index.block[post], index.block_max[post], n * blocks).reshape(n, blocks)
    both = sums.copy()
    both[:-1] += sums[1:]
    ends = first[1:] - 1  # the last chunk of a text has no next one
    both[ends] = sums[ends]
    at, block = np.nonzero(both + rest >= threshold - 1e-4)
    text = np.searchsorted(first, at, side="right") - 1
    return zip(text.tolist(), (at - first[text]).tolist(), block.tolist())


def _score(own: list[bytes], start: int, block: int, index: Index, threshold: float, overlap: float, out: dict) -> None:
    words = set(own)
    pairs = None
    for item in range(block * BLOCK, min((block + 1) * BLOCK, len(index.items))):
        impact = index.impact[item]
        score = sum(s for t, s in impact.items() if t in words)
        if score < threshold - 1e-9:
            continue
        if pairs is None:
            pairs = set(zip(own, own[1:])) | words
        shares = [tuple(_share(p, pairs) for p in split) for split in index.parts[item]]
        held = max(map(min, shares)) >= overlap or _share(index.whole[item], pairs) >= WHOLE
        if held and (item not in out or score > out[item][0]):
            out[item] = (score, start, *shares[0])


def _share(part: set, pairs: set) -> float:
    """Share of the pairs that stand in the passage; nothing always does."""
    return len(part & pairs) / len(part) if part else 1.0


def _index_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Index:
    return build([(r[0], r[1]) for r in items.select(id_col, text_col).collect()])


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
          overlap: float = OVERLAP) -> DataFrame:
    """One row per document and test item found in it: the document's other columns,
    ``item_id, score, first_word, question_share, answer_share``."""
    spark = docs.sparkSession
    bound_batches(spark)
    index = spark.sparkContext.broadcast(_index_of(items))
    added = ["item_id", "score", "first_word", "question_share", "answer_share"]
    kept = [f for f in docs.schema.fields if f.name not in [*added, text_col]]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("score", T.DoubleType()),
                                  T.StructField("first_word", T.LongType()), T.StructField("question_share", T.DoubleType()),
                                  T.StructField("answer_share", T.DoubleType())])

    def run(batches):
        own = index.value
        for batch in batches:
            for part in slices(batch, text_col):
                rows = [(k, own.items[i], *v) for k, f in enumerate(search(texts_bytes(part, text_col), own, threshold, overlap))
                        for i, v in sorted(f.items())]
                if not rows:
                    continue
                k, item, score, start, q, a = map(list, zip(*rows))
                at = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(n).take(at) for n in names]
                    + [pa.array(item), pa.array(score, pa.float64()), pa.array(start, pa.int64()), pa.array(q, pa.float64()),
                       pa.array(a, pa.float64())], names=names + added)

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", threshold: float = THRESHOLD,
          overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` in which no test item is found, unchanged."""
    spark = docs.sparkSession
    bound_batches(spark)
    index = spark.sparkContext.broadcast(_index_of(items))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                found = search(texts_bytes(part, text_col), index.value, threshold, overlap)
                yield part.filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
