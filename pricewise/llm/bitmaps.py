"""Which 64-bit keys occur in a table, or in more than one of its rows, as a bitmap.

Tasks send their distinct keys, sorted and packed as binary, to buckets by key
range; a bucket marks the keys that two rows have. Of a key its bucket and the next
32 bits count, and the bitmap has a fixed size, so it can be broadcast whatever the
input: keys that share all that let a few single ones pass, but no repeated one is lost.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 27
#: Keys that a task holds before it sends them.
HELD = 1_000_000


def repeated(source: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]],
             hot: int, every: bool = False, bits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of the repeated keys, leading bits of the keys that occur more than
    ``hot`` times, for ``among``); with ``every`` the bitmap has all keys.

    ``keys_of`` turns the batches of a task into (keys, owners) arrays; a key that
    only one owner has is not repeated. Owners are compared within a task, and all
    rows of an owner must come in one array. ``bits`` is the logarithm of the bitmap's
    size (default ``BITS``); ``holds`` works on bitmaps of any size.
    """
    spark = source.sparkSession
    wide = bits or BITS
    buckets = 16
    while buckets < 4 * int(spark.conf.get("spark.sql.shuffle.partitions")):
        buckets *= 2
    bits = buckets.bit_length() - 1
    wide = max(wide, bits + 3)
    shift = np.uint64(64 - bits)

    def rows(kept):
        a, owner = (np.concatenate(c) for c in zip(*kept))
        order = np.argsort(a, kind="stable")
        a, owner = a[order], owner[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        n = np.diff(np.append(first, len(a)))
        a = a[first]
        edge = np.searchsorted(a, np.arange(buckets, dtype=np.uint64) << shift)
        a = (a >> (shift - np.uint64(32))).astype("<u4")
        for b, (lo, hi) in enumerate(zip(edge.tolist(), [*edge[1:].tolist(), len(a)])):
            if lo < hi:
                many = np.flatnonzero(n[lo:hi] > 1)
                blobs = [a[lo:hi], np.packbits(several[lo:hi]), many.astype("<u4"), n[lo:hi][many].astype("<u4")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]],
                    names=["bucket", "keys", "several", "many", "counts"])

    def send(batches):
        kept, held = [], 0
        for a, owner in keys_of(batches):
            kept.append((a, owner))
            held += len(a)
            if held > HELD:
                yield from rows(kept)
                kept, held = [], 0
        if held:
            yield from rows(kept)

    def mark(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["keys"], "<u4")
                several = np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(a)).astype(bool)
                n = np.ones(len(a), np.int64)
                n[np.frombuffer(r["many"], "<u4")] = np.frombuffer(r["counts"], "<u4")
                got.setdefault(r["bucket"], []).append((a, several, n))
        width = (1 << wide) // buckets
        for b, parts in got.items():
            a, several, n = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(a, kind="stable")
            a, several, n = a[order], several[order], n[order]
            first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            # what two sendings have, two rows have
            rep = np.logical_or.reduceat(several, first) | (np.diff(np.append(first, len(a))) > 1) | every
            marks = np.zeros(width, dtype=np.uint8)
            marks[a[first][rep] >> np.uint32(32 + bits - wide)] = 1
            often = a[first][np.add.reduceat(n, first) > hot].astype(np.uint64) + np.uint64(b << 32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([np.packbits(marks).tobytes()], pa.binary()), pa.array([often.tobytes()], pa.binary())],
                names=["bucket", "bits", "hot"])

    sent = source.mapInArrow(send, "bucket int, keys binary, several binary, many binary, counts binary")
    bitmap = np.zeros((1 << wide) // 8, dtype=np.uint8)
    often = [np.empty(0, np.uint64)]
    size = len(bitmap) // buckets
    for r in sent.repartition("bucket").mapInArrow(mark, "bucket int, bits binary, hot binary").collect():
        bitmap[r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
        often.append(np.frombuffer(r["hot"], "<u8"))
    return bitmap, np.append(np.uint64(bits), np.sort(np.concatenate(often)))


def id_keys(ids: pa.Array) -> np.ndarray:
    """Hashed ids; null has the key of -1."""
    h = ids.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def of_ids(rows: DataFrame) -> np.ndarray:
    """Bitmap of the ids in the column ``doc_id``."""

    def keys(batches):
        for batch in batches:
            a = id_keys(batch.column("doc_id"))
            yield a, np.zeros(len(a), np.int64)

    return repeated(rows.select("doc_id"), keys, hot=1 << 62, every=True)[0]


def among(hot: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is one of the hot keys that ``repeated`` gave (or shares their leading bits)."""
    return np.isin(keys >> (np.uint64(32) - hot[0]), hot[1:])


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set."""
    place = keys >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
