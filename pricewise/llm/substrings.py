"""Substring dedup over words, by a compressed FM-index for each shard.

A window is ``LENGTH`` consecutive words of one document. Every word covered by a window
whose words also stand at an earlier place (a smaller id, or earlier in the same document)
is removed; windows are judged on the input. What repeats at all is brought together by
``places``: a shard gets the different segments whose windows can be equal, builds an
FM-index of them over a wavelet tree (``fm_index``), and streams each segment through it by
backward search. Where the matching statistics reach ``LENGTH`` the interval of rows is
reported, and the earliest place in it tells whether the window repeats.

Defined results. Null texts have no words. Rows without id stay whole and are no source.
Rows of one id count in the order of a hash of their texts, equal rows are one document and
are cut alike. Texts with fewer words than ``LENGTH`` stay. An empty table gives no rows.
Input columns named as the added ones are replaced. Words and segments are compared by
64-bit hashes.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import places
from .fm_index import FMIndex
from .words import classes, join, words_of

LENGTH = 20
GRAM = 8
_TABLE = classes(b" \t\n\x0b\x0c\r", b"")
FIELDS = (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()))


def segments(texts: list[bytes], hot=None, length: int = LENGTH, gram: int = GRAM) -> places.Segments:
    """Segments over the words of ``texts`` (see ``places``)."""
    w = words_of(texts, _TABLE)
    size = np.bincount(w.text, minlength=len(texts)).astype(np.int64)
    h = w.hash
    have = 1
    while have < gram:  # grams of 2, 4, ... words, then of ``gram``
        step = min(have, gram - have)
        h = join(h[:len(h) - step], h[step:]) if len(h) > step else h[:0]
        have += step
    text, start, count, anchor, name = places.cut_segments(h, size, length, gram, hot)
    at = (np.cumsum(size) - size)[text] + start
    return places.Segments(text, start, count, anchor, name, w.start[at] - w.begin[text], w.end[at + count + length - 2] - w.begin[text])


def repeats(pieces: list[bytes], doc: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows that stand at an earlier (doc, place) too."""
    w = words_of(pieces, _TABLE)
    size = np.bincount(w.text, minlength=len(pieces)).astype(np.int64)
    symbols = np.unique(w.hash, return_inverse=True)[1] + 1
    index = FMIndex(symbols, size, cap=length)
    got, low, _ = index.matching_statistics(symbols, size)
    offset = np.arange(len(symbols)) - np.repeat(np.cumsum(size) - size, size)
    place = (doc[w.text] << 32) + at[w.text] + offset  # of every word, in the order of places
    # rows count an end mark after every piece
    words = np.cumsum(size + 1) - size - 1
    whole = np.full(len(symbols) + len(size), np.iinfo(np.int64).max)
    whole[words[w.text] + offset] = place
    value = whole[index.rows]
    earliest = np.minimum.reduceat(value, index.group_edge[:-1]) if len(value) else value
    on = np.flatnonzero(got >= length)
    on = on[earliest[index.group[low[on]]] < place[on]]
    return w.text[on], offset[on]


def finish(texts: list[bytes], spans: list) -> list[pa.Array]:
    """Columns ``n_words, n_removed, kept``."""
    total, removed, kept = [], [], []
    for t, s in zip(texts, spans):
        words = t.split()  # bytes split at space and 0x09-0x0D only
        gone = places.covered(s, len(words))
        total.append(len(words))
        removed.append(0 if gone is None else int(gone.sum()))
        kept.append(b" ".join(words if gone is None else [x for x, g in zip(words, gone.tolist()) if not g]))
    return [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)]


def method(length: int = LENGTH) -> places.Method:
    gram = min(GRAM, length)
    return places.Method(length, partial(segments, length=length, gram=gram), partial(repeats, length=length), finish, FIELDS)


def dedup(docs: DataFrame, text_col: str = "text", length: int = LENGTH, hot: int = places.HOT) -> DataFrame:
    """``docs`` with ``n_words, n_removed`` and ``kept``, the words that stay."""
    return places.run(docs, method(length), text_col, hot)


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL: every window of every text."""
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, md5_number(array_to_string(list_slice(w, p, p + {length - 1}), ' ')) AS k FROM (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - {length} + 2, 1))) AS p FROM docs)),
firsts AS (SELECT k, min({{'d': doc_id, 'p': p}}) AS f FROM windows GROUP BY k HAVING count(*) > 1),
hits AS (SELECT doc_id, p FROM windows JOIN firsts USING (k) WHERE f < {{'d': doc_id, 'p': p}}),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {length})) AS p FROM hits),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
rest AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN rest USING (doc_id)
"""
