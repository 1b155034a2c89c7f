"""Words of many texts at once: places and 64-bit hashes, by array operations on bytes."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Classes of bytes: part of a word, blank between words, end of a piece.
WORD, BLANK, END = 0, 1, 2
_MULTIPLIER = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(_MULTIPLIER), np.uint64(0xC2B2AE3D27D4EB4F)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a followed by b; the order counts."""
    return mix(mix(a + _M1) * _M1 + b)


def classes(blank: bytes, end: bytes) -> np.ndarray:
    """Table from byte to class."""
    table = np.zeros(256, dtype=np.uint8)
    table[list(blank)] = BLANK
    table[list(end)] = END
    return table


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        size = max(n, 1 << 18)
        _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_MULTIPLIER, inverse))
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of the joined texts: bytes [start, end), text number, hash, and whether a
    piece ends between the word and its predecessor (true for the first word of a text)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    new: np.ndarray
    begin: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


def words_of(texts: list[bytes], table: np.ndarray, lower: bool = False) -> Words:
    """The words of ``texts``; ``lower`` puts a-z for A-Z."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    if lower:
        data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    kind = table[data]
    kind[(begin + size)[:len(size)]] = END  # the joint between two texts
    inside = np.concatenate([[False], kind == WORD, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _raised(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2)
    text = np.searchsorted(begin, start, side="right") - 1
    ends = np.concatenate([[0], np.cumsum(kind == END)])
    before = ends[start]
    new = np.append(True, before[1:] != before[:-1]) if len(start) else np.empty(0, bool)
    return Words(data, start, end, text, h, new, begin)
