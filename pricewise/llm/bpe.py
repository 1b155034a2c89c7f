"""Byte-level BPE, encoding and decoding.

Pre-tokenisation runs on arrays, without regular expressions. Every code point
of a slice of texts gets a class (letter, number, space, other white space,
apostrophe of a contraction, rest), refined by what follows it. Each class is a
transition function over a few scanner states; functions form a small monoid,
so the state before every character comes from an associative scan (columns of
a matrix at once, then the row totals by the same scan). State and class tell
whether a token starts there. The slices feed a cache of merged pieces; a miss
merges pairs by rank. Token boundaries are kept as byte offsets.

Null texts encode to no ids. One output row per input row.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bound_batches, slices, texts_str

# Scanner states: what the token that is open after a character is.
NONE, LETTERS, NUMBERS, OTHERS, WHITE, GLUED, TWO_LEFT, ONE_LEFT = range(8)
# Classes: the last three depend on what follows the character.
LETTER, NUMBER, OTHER, WHITE_RUN, WHITE_LAST, SPACE_LAST, SHORT_MARK, LONG_MARK = range(8)
N_STATES, N_CLASSES = 8, 8

# Code points of white space, suffixes of contractions.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
SHORT_SUFFIXES = ["s", "t", "m", "d"]
LONG_SUFFIXES = ["re", "ve", "ll"]
# Ranges of letters and numbers that Unicode 16 added; the libraries know
# them, Python's own table may be older.
NEWER_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEWER_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
]

#: Entries of the piece cache of a worker, about 200 bytes each.
CACHE_PIECES = 600_000
#: Longer pieces merge with a heap and are not remembered.
SHORT_PIECE = 48
_NO_RANK = 1 << 60
_COLUMNS = 64


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, does a token start at this character)."""
    if state in (TWO_LEFT, ONE_LEFT):  # letters of a contraction, whatever their class
        return (ONE_LEFT if state == TWO_LEFT else NONE), False
    runs = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}
    if cls in (SHORT_MARK, LONG_MARK):
        if state in (OTHERS, GLUED):
            return OTHERS, False
        return (ONE_LEFT if cls == SHORT_MARK else TWO_LEFT), True
    if cls in runs:
        return runs[cls], state not in (runs[cls], GLUED)
    if cls == WHITE_RUN:
        return WHITE, state != WHITE
    return (GLUED if cls == SPACE_LAST else NONE), True


class _Monoid:
    """Transition functions closed under composition. Function ``c`` is class ``c``;
    ``c + N_CLASSES`` is the same at the first character of a text."""

    def __init__(self):
        funcs = [tuple(_step(s, c)[0] for s in range(N_STATES)) for c in range(N_CLASSES)]
        funcs += [tuple([f[NONE]] * N_STATES) for f in funcs]
        index = {}
        table = []
        for f in funcs:
            index.setdefault(f, len(table))
            table.append(f)  # generators keep their numbers, also where two are equal
        done = False
        while not done:
            done = True
            for f in list(table):
                for g in list(table):
                    h = tuple(g[s] for s in f)  # f, then g
                    if h not in index:
                        index[h] = len(table)
                        table.append(h)
                        done = False
        self.size = len(table)
        self.apply = np.array(table, dtype=np.uint8)
        self.then = np.array([[index[tuple(g[s] for s in f)] for g in table] for f in table], dtype=np.uint16).ravel()
        starts = np.array([[_step(s, c)[1] for s in range(N_STATES)] for c in range(N_CLASSES)])
        self.starts = np.vstack([starts, np.ones_like(starts)])

    def prefix(self, f: np.ndarray) -> np.ndarray:
        """Composition of ``f[0] .. f[i]`` for every ``i``."""
        n = len(f)
        if n <= _COLUMNS:
            out = f.astype(np.uint16)
            for i in range(1, n):
                out[i] = self.then[int(out[i - 1]) * self.size + int(f[i])]
            return out
        rows = -(-n // _COLUMNS)
        grid = np.zeros(rows * _COLUMNS, dtype=np.uint16)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, _COLUMNS).T)
        for k in range(1, _COLUMNS):
            grid[k] = self.then[grid[k - 1].astype(np.int32) * self.size + grid[k]]
        before = self.prefix(grid[-1])[:-1]
        grid[:, 1:] = self.then[before.astype(np.int32) * self.size + grid[:, 1:]]
        return grid.T.reshape(-1)[:n]

    def states_before(self, f: np.ndarray) -> np.ndarray:
        """Scanner state before every character."""
        out = np.empty(len(f), dtype=np.uint8)
        out[0] = NONE
        out[1:] = self.apply[self.prefix(f)[:-1], NONE]
        return out


@lru_cache(maxsize=1)
def _monoid() -> _Monoid:
    return _Monoid()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point, from Unicode's general categories (version 16)."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        k = kind.get(unicodedata.category(chr(c))[0])
        if k is not None:
            table[c] = k
    for cls, ranges in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
        for lo, hi in ranges:
            table[lo:hi + 1] = cls
    table[WHITE_SPACE] = WHITE_RUN
    return table


def token_starts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, is a token's start, first place of each text)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(points)
    first = np.cumsum(sizes) - sizes
    if not n:
        return points, np.zeros(0, bool), first
    opens = np.zeros(n + 1, dtype=bool)
    opens[first[sizes > 0]] = True
    opens[n] = True
    cls = _classes()[points]
    white = cls == WHITE_RUN
    # white space right before a character of the same text that is none
    final = white.copy()
    final[:-1] &= ~white[1:]
    final &= ~opens[1:]
    cls[final] = np.where(points[final] == 32, SPACE_LAST, WHITE_LAST)
    for at in (np.flatnonzero(points == 39),):
        text_end = np.append(first, n)[np.searchsorted(first, at, side="right")] if len(at) else at
        # empty texts share their place with the next one; searchsorted takes the last of equals
        one = np.where(at + 1 < text_end, points[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < text_end, points[np.minimum(at + 2, n - 1)], 0)
        cls[at[np.isin(one, [ord(s) for s in SHORT_SUFFIXES])]] = SHORT_MARK
        for s in LONG_SUFFIXES:
            cls[at[(one == ord(s[0])) & (two == ord(s[1]))]] = LONG_MARK
    symbol = cls.astype(np.uint16)
    symbol[opens[:n]] += N_CLASSES
    m = _monoid()
    return points, m.starts[symbol, m.states_before(symbol)], first


def byte_starts(points: np.ndarray) -> np.ndarray:
    """Byte offset of each code point, and the end."""
    size = np.ones(len(points) + 1, dtype=np.int64)
    size[0] = 0
    if len(points) and points.max() >= 128:
        size[1:] += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.cumsum(size)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i:i + 1] for i in range(len(piece))]
    pair = [ranks.get(a + b, _NO_RANK) for a, b in zip(parts, parts[1:])]
    while pair:
        best = min(pair)
        if best == _NO_RANK:
            break
        i = pair.index(best)
        parts[i] += parts.pop(i + 1)
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], _NO_RANK)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], _NO_RANK)
    return [ranks[t] for t in parts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of lowest rank, the leftmost of equals, merges first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) <= SHORT_PIECE:
        return _merge_short(piece, ranks)
    n = len(piece)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    ends = list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != end:
            continue  # one of the pair has merged meanwhile
        alive[j] = False
        ends[i], after[i] = end, after[j]
        if after[j] < n:
            before[after[j]] = i
            r = ranks.get(piece[i:ends[after[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if before[i] >= 0:
            r = ranks.get(piece[before[i]:end])
            if r is not None:
                heapq.heappush(heap, (r, before[i], end))
    return [ranks[piece[i:ends[i]]] for i in range(n) if alive[i]]


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; remembers merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        ids = merge(piece, self.ranks)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= SHORT_PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = out
        return out


def split(texts: list[str]) -> list[tuple[list[bytes], np.ndarray]]:
    """Pieces of each text and their byte offsets in it."""
    points, starts, first = token_starts(texts)
    at = byte_starts(points)
    data = "".join(texts).encode("utf-8", "replace")
    place = np.flatnonzero(starts)
    bounds = at[np.append(place, len(points))]
    cut = np.append(np.searchsorted(place, first), len(place))
    edge = bounds.tolist()
    parts = [data[a:b] for a, b in zip(edge, edge[1:])]
    return [(parts[a:b], bounds[a:b] - at[f]) for a, b, f in zip(cut.tolist(), cut[1:].tolist(), first.tolist())]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.pieces = Pieces(self.ranks)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.decimal = [b"%d" % i for i in range(len(self.tokens))]

    def encode(self, pieces: list[bytes]) -> np.ndarray:
        """Ids of the pieces of a text."""
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pieces)), dtype="<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> bytes:
        """Decimal ids joined by a space."""
        return b" ".join(map(self.decimal.__getitem__, ids))


def _clean(texts: list[str]) -> list[str]:
    """Lone surrogates, which UTF-8 has no form for, as U+FFFD."""
    return [t if t.isascii() else t.encode("utf-8", "replace").decode("utf-8") for t in texts]


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text: ``ids`` and ``offsets``, the byte
    offsets at which pre-tokens start."""
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "offsets", text_col)]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField("ids", T.ArrayType(T.IntegerType())),
                                  T.StructField("offsets", T.ArrayType(T.LongType()))])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                found = split(_clean(texts_str(part, text_col)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names]
                    + [pa.array([codec.encode(p).astype(np.int32) for p, _ in found], pa.list_(pa.int32())),
                       pa.array([o for _, o in found], pa.list_(pa.int64()))], names=names + ["ids", "offsets"])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Every row of ``tokens`` without its ids: ``data``, the bytes they stand for."""
    kept = [f for f in tokens.schema.fields if f.name not in ("data", ids_col)]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField("data", T.BinaryType())])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            data = [codec.decode(i or []) for i in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(data, pa.binary())],
                                             names=names + ["data"])

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, without moving ids out of the task: every
    row of ``docs`` without its text, ``n_tokens``, ``ids_sha256`` (decimal ids
    joined by a space) and ``decoded_sha256`` (bytes decoded from the ids)."""
    bound_batches(docs.sparkSession)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [f for f in docs.schema.fields if f.name not in [*added, text_col]]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                                  T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                count, ids_hash, data_hash = [], [], []
                for pieces, _ in split(_clean(texts_str(part, text_col))):
                    ids = codec.encode(pieces).tolist()
                    count.append(len(ids))
                    ids_hash.append(hashlib.sha256(codec.listed(ids)).hexdigest())
                    data_hash.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names]
                    + [pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(data_hash, pa.string())],
                    names=names + added)

    return docs.mapInArrow(run, schema)
