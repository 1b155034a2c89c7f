"""Toxicity: a factorization machine over hashed terms.

A text is the set of its distinct terms (lower-cased runs of letters, and the first
``PREFIXES`` bytes of longer ones), hashed into ``2**TERM_BITS`` ids. The score is the logistic of

    bias + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

so that pairs of terms count, which additive weights miss. Both parts are
trained with proximal AdaGrad: a soft threshold takes weights and whole factor
rows of uninformative terms to zero, so a long text does not add up noise.

Training uses a bounded sample of labelled rows (``SAMPLE_DOCS`` of each label,
texts up to ``SAMPLE_CHARS`` characters; smallest hash of the id first), and only
those whose crc32(doc_id as text) mod 4 is not 2. Labels, language, source and id
are never inputs of a score. Terms outside the sample's table weigh nothing.

Null texts score as empty ones. One output row per input row; without labelled
rows of both kinds every score is 0.
"""
from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, slices, texts_bytes

TERM_BITS = 32
PREFIXES = (4, 5)  # bytes
FACTORS = 8
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
LEAST_DOCS = 3
SELECT_SHRINK = 0.015
FINAL_SHRINK = 1e-3
FACTOR_SHRINK = 0.02
CUT = 0.3
HELD_OUT = 2

# every byte that is an ASCII letter in lower case, or a part of a longer character; else a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> set[bytes]:
    """Distinct words, and the beginnings of the longer ones, which inflected forms share."""
    words = set(text.translate(_FOLD).split())
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + b"-" for w in words if len(w) > n])
    return out


def term_id(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << TERM_BITS) - 1)


@dataclass
class Machine:
    ids: np.ndarray      # sorted term ids of the table
    bias: float
    weight: np.ndarray   # terms
    factor: np.ndarray   # terms x FACTORS

    def rows(self) -> "TermRows":
        return TermRows(self.ids)

    def raw(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores before the logistic; ``rows`` are table rows of the texts' terms, one text after another."""
        ends = np.cumsum(lengths)
        total = np.empty(len(lengths))
        w = np.append(0.0, np.cumsum(self.weight[rows]))
        total = self.bias + w[ends] - w[ends - lengths]
        v = self.factor[rows]
        s = np.vstack([np.zeros(FACTORS), np.cumsum(v, axis=0)])
        q = np.append(0.0, np.cumsum((v * v).sum(axis=1)))
        sums = s[ends] - s[ends - lengths]
        return total + 0.5 * ((sums * sums).sum(axis=1) - (q[ends] - q[ends - lengths]))


class TermRows(dict):
    """Term -> its row in the table, or -1; remembers what it was asked for."""

    MOST = 500_000

    def __init__(self, ids: np.ndarray):
        super().__init__()
        self.ids = ids

    def __missing__(self, term: bytes) -> int:
        if len(self) > self.MOST:
            self.clear()
        h = term_id(term)
        k = int(np.searchsorted(self.ids, h))
        row = k if k < len(self.ids) and self.ids[k] == h else -1
        self[term] = row
        return row


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], y: np.ndarray, seed: int = 7) -> Machine:
    """Train on texts with labels 0/1: first with strong shrinkage and both labels
    of the same weight, which selects terms; then again on the selected terms, with
    little shrinkage and the labels' own weights, which sets the scale."""
    sets = [np.unique(np.fromiter(map(term_id, terms(x)), dtype=np.int64)) for x in texts]
    ids, df = np.unique(np.concatenate(sets), return_counts=True)
    ids = ids[df >= LEAST_DOCS]
    even = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    chosen = _descend(sets, y, ids, even, rounds=30, shrink=SELECT_SHRINK, seed=seed)
    return _descend(sets, y, chosen.ids, np.full(len(y), 1 / len(y)), rounds=150, shrink=FINAL_SHRINK, seed=seed)


def _descend(sets: list[np.ndarray], y: np.ndarray, ids: np.ndarray, mass: np.ndarray, rounds: int, shrink: float,
             seed: int, rate: float = 0.5) -> Machine:
    """Full-batch proximal AdaGrad. A weight stays zero unless the mean gradient of
    its term exceeds ``shrink``, a factor row unless its norm exceeds ``FACTOR_SHRINK``."""
    rows = [np.flatnonzero(np.isin(ids, h, assume_unique=True)) for h in sets]
    at, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    rng = np.random.default_rng(seed)
    m = Machine(ids, 0.0, np.zeros(len(ids)), rng.normal(0, 0.02, (len(ids), FACTORS)))
    gw, gv, gb = np.full(len(ids), 1e-12), np.full(len(ids), 1e-12), 1e-12
    for _ in range(rounds):
        gap = (_sigmoid(m.raw(at, lengths)) - y) * mass
        each = np.repeat(gap, lengths)
        v = m.factor[at]
        s = np.vstack([np.zeros(FACTORS), np.cumsum(v, axis=0)])
        others = np.repeat(s[ends] - s[ends - lengths], lengths, axis=0) - v
        dw = np.bincount(at, each, len(ids))
        dv = np.stack([np.bincount(at, each * others[:, f], len(ids)) for f in range(FACTORS)], axis=1)
        db = gap.sum()
        gw, gv, gb = gw + dw * dw, gv + (dv * dv).sum(axis=1), gb + db * db
        lw, lv = rate / np.sqrt(gw), 0.1 * rate / np.sqrt(gv)
        w = m.weight - lw * dw
        v = m.factor - lv[:, None] * dv
        norm = np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)
        m = Machine(ids, m.bias - rate / np.sqrt(gb) * db,
                    np.sign(w) * np.maximum(np.abs(w) - lw * shrink, 0.0),
                    v * np.maximum(1 - lv * FACTOR_SHRINK / norm, 0.0)[:, None])
    live = (m.weight != 0) | (m.factor != 0).any(axis=1)
    return Machine(ids[live], float(m.bias), m.weight[live], m.factor[live])


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS) -> Machine | None:
    """Fit on the bounded sample; None without rows of both labels."""
    ids = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
           .select("doc_id", "toxic").distinct())
    toxic = {}
    for k in (0, 1):
        for r in ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
            toxic[r["doc_id"]] = k
    if len(set(toxic.values())) < 2:
        return None
    rows = (docs.where(F.col("doc_id").isin(list(toxic)) & (F.length(text_col) <= SAMPLE_CHARS))
            .select("doc_id", text_col).collect())
    rows.sort(key=lambda r: (r["doc_id"], r[text_col]))
    return fit([r[text_col].encode("utf-8", "replace") for r in rows], np.array([toxic[r["doc_id"]] for r in rows], float))


def scores(texts: list[bytes], model: Machine | None, rows: TermRows | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    found, lengths = [], []
    for text in texts:
        at = sorted({rows[t] for t in terms(text)} - {-1})
        found += at
        lengths.append(len(at))
    return _sigmoid(model.raw(np.array(found, dtype=np.int64), np.array(lengths, dtype=np.int64)))


def score(docs: DataFrame, model: Machine | None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (score >= CUT)."""
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        rows = model.rows() if model is not None else None
        for batch in batches:
            for part in slices(batch, text_col):
                s = scores(texts_bytes(part, text_col), model, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                    names=names + ["score", "predicted"])

    return docs.mapInArrow(run, schema)
