"""Repeated windows of a corpus, met by anchor: what the search for long repeats has to
move between tasks, whatever its unit (bytes or words) and its index.

* A *window* is ``length`` consecutive units. Its *anchor* is its ``gram`` units with the
  smallest hash (the leftmost of equals), so equal windows have equal anchors. Successive
  windows with one anchor form a *segment*, named by a hash of its units.
* Anchors that stand at one place only cannot repeat; a bitmap of the others drops most of
  the text. Segments of anchors with more than ``HOT`` places are cut into single windows,
  whose anchor is their name, so that no group of different segments grows beyond that.
* Of every segment the *first place* in the order of documents is found by an aggregation
  that combines inside tasks: copies cost one entry for each task, not one for each copy.
* A bitmap of the first places tells, where the texts are read, that a place is not the
  first of its segment: all its windows repeat, and nothing has to be sent. Only places
  that may be first send their units, to the bucket of their anchor. There an index of the
  different segments tells which of their windows stand somewhere before.
* Those spans go to buckets of documents and meet the texts that have any.

All exchanges are of packed arrays. Buckets and bitmaps follow the bytes of the input.
Rows of one id count in the order of a hash of their texts; equal rows are one place.
Rows without id are neither sources nor cut. Segments are told apart by 64-bit names.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitmaps import among, holds, repeated
from .common import bound_batches, materialise, slices, texts_bytes
from .words import mix

HOT = 50_000
#: Bytes of text for each bucket, and at once in the array operations.
BUCKET_BYTES = 16 << 20
SLICE = 1 << 18
#: Places or spans that a task holds before it packs them.
HELD = 150_000
#: Units of the segments in one index.
INDEX_UNITS = 1_000_000
_PLACE_BITS = np.uint64(24)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_FIRST = np.dtype([("anchor", "<u4"), ("name", "<u8"), ("doc", "<i8"), ("key", "<u4"), ("at", "<u4")])
_SENT = np.dtype([("anchor", "<u4"), ("name", "<u8"), ("doc", "<i8"), ("key", "<u4"), ("at", "<u4"), ("n", "<u4"), ("bytes", "<u4")])
_SPAN = np.dtype([("doc", "<i8"), ("key", "<u4"), ("start", "<u4"), ("size", "<u4")])
_ROW = "kind int, bucket int, data binary, bytes binary"
_FIRSTS, _SENDS, _SPANS = range(3)


@dataclass(frozen=True)
class Segments:
    """Stretches of windows: text number, first window, number of windows, anchor, name,
    and the bytes [lo, hi) of the text that hold their units."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def of(self, on) -> "Segments":
        return Segments(*(x[on] for x in (self.text, self.start, self.count, self.anchor, self.name, self.lo, self.hi)))


@dataclass(frozen=True)
class Method:
    """A unit and its index. ``segments(texts, hot)`` gives ``Segments``; ``repeats(pieces,
    doc, at)`` gives (piece number, window) of the windows of ``pieces`` that another piece
    (or the same one) has at an earlier (doc, at + window); ``finish(texts, spans)`` the
    columns that are added to the rows, named and typed by ``fields``.

    ``by_doc``: only a smaller document id counts as earlier, whatever the text or place.
    ``alone``: segments that are the only ones of their anchor go through the index as well
    (nothing can be found for them there)."""

    length: int
    segments: Callable
    repeats: Callable
    finish: Callable
    fields: tuple
    by_doc: bool = False
    alone: bool = True
    index_units: int | None = None
    bucket_bytes: int | None = None


def cut_segments(h: np.ndarray, size: np.ndarray, length: int, gram: int, hot: np.ndarray | None):
    """(text number, first window, windows, anchor, name) of the segments of joined texts.
    ``h``: hash of the ``gram`` units from each unit on, ``size``: units of each text."""
    begin = np.cumsum(size) - size
    w = length - gram + 1
    out_q, out_p = [], []
    block = (1 << int(_PLACE_BITS)) - 4 * length
    for lo in range(0, len(h), block):
        part = h[lo:lo + block + w - 1]
        x = (part >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(part), dtype=np.uint64)
        if len(x) < w:
            break
        have = 1
        while have * 2 <= w:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if w > have:
            x = np.minimum(x[:len(x) - (w - have)], x[w - have:])
        out_q.append((x & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64) + lo)
        out_p.append(np.arange(lo, lo + len(x)))
    if not out_q:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    q, p = np.concatenate(out_q), np.concatenate(out_p)
    text = np.repeat(np.arange(len(size)), size)[p]
    inside = p + length <= (begin + size)[text]
    q, p, text = q[inside], p[inside], text[inside]
    new = np.append(True, (q[1:] != q[:-1]) | (text[1:] != text[:-1])) if len(q) else np.empty(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(p)))
    # smallest hashes lie close to 0: scrambled again, they fall evenly into buckets and bitmaps
    text, start, anchor = text[first], p[first], mix(h[q[first]] * _M1)
    split = among(hot, anchor) if hot is not None and len(hot) > 1 else np.zeros(len(first), bool)
    if split.any():
        times = np.where(split, count, 1)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        text, start, anchor, split = (np.repeat(x, times) for x in (text, start, anchor, split))
        start, count = start + step, np.where(split, 1, np.repeat(count, times))
    units = count + length - 1
    name = mix(units.astype(np.uint64) * _M1)
    for at in range(0, w + length - 1, gram):  # the last ones are moved back to the end
        name = mix((name ^ h[np.minimum(start + at, start + units - gram)]) * _M2)
    return text, start - begin[text], count, np.where(split, name, anchor), name


# -------------------------------------------------------------------- packing
def _row(kind: int, bucket: int, data: np.ndarray, text: bytes | None = None) -> pa.RecordBatch:
    """Columns of a structured array one after another, which compresses better than rows."""
    blob = b"".join(np.ascontiguousarray(data[n]).tobytes() for n in data.dtype.names)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([text], pa.binary())],
        names=["kind", "bucket", "data", "bytes"])


def _array(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n, at = len(blob) // dtype.itemsize, 0
    out = np.empty(n, dtype)
    for name in dtype.names:
        out[name] = np.frombuffer(blob, dtype[name], n, at)
        at += n * dtype[name].itemsize
    return out


def _parts(bucket: np.ndarray):
    """(bucket, slice) of the stretches of a sorted array."""
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)]):
        yield int(bucket[lo]), slice(lo, hi)


def _by_bucket(batches, finish):
    """Gather the rows of each bucket (rows come sorted by bucket) and ``finish`` it."""
    held, bucket = [], None
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket and held:
                yield from finish(bucket, held)
                held = []
            bucket = r["bucket"]
            held.append(r)
    if held:
        yield from finish(bucket, held)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind")


def _packed_spans(doc, key, start, size, bits: int):
    out = np.empty(len(doc), _SPAN)
    out["doc"], out["key"], out["start"], out["size"] = doc, key, start, size
    bucket = (_row_hash(out["doc"], out["key"]) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out = out[order]
    for b, part in _parts(bucket[order]):
        yield _row(_SPANS, b, out[part])


def _row_hash(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64) * _M1) ^ key.astype(np.uint64) * _M2)


def _place_hash(name, doc, key, at, by_doc: bool) -> np.ndarray:
    if by_doc:
        key, at = np.zeros(len(doc), np.uint32), np.zeros(len(doc), np.int64)
    return mix((_row_hash(doc, key) ^ name) + at.astype(np.uint64) * _M1)


# ---------------------------------------------------------------------- steps
def _segmented(text_col: str, segments: Callable):
    """A function from (batches, hot anchors) to (rows, texts, segments) of slices of a task's rows."""

    def each(batches, hot):
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                texts = [t if ok else b"" for t, ok in zip(texts_bytes(part, text_col), part.column("doc_id").is_valid().to_pylist())]
                yield part, texts, segments(texts, hot)

    return each


class Search:
    """The steps over one table, with what is known so far."""

    def __init__(self, docs: DataFrame, method: Method, text_col: str = "text", hot: int = HOT):
        self.spark = docs.sparkSession
        bound_batches(self.spark)
        self.docs, self.method, self.text_col, self.hot = docs, method, text_col, hot
        total = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
        #: logarithms: buckets, and bits of a bitmap
        self.bits = max(4, (total // (method.bucket_bytes or BUCKET_BYTES)).bit_length())
        self.wide = min(31, max(20, (total // 8).bit_length()))

    def read(self) -> DataFrame:
        return self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), self.text_col,
                                F.xxhash64(self.text_col).bitwiseAND(F.lit(0xFFFFFFFF)).alias("_key"))

    def _repeated(self, hot, only_hot: bool):
        each, rows, by_doc = _segmented(self.text_col, self.method.segments), self.read(), self.method.by_doc

        def keys(batches):
            number = 0
            for _, texts, s in each(batches, hot):
                if only_hot:
                    s = s.of(s.anchor == s.name)
                n = len(s.anchor)
                yield s.anchor, number + (s.text if by_doc else np.arange(n))
                number += len(texts) if by_doc else n

        return repeated(rows, keys, self.hot, bits=self.wide)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(bitmap of the anchors with more than one place, hot anchors)."""
        bitmap, hot = self._repeated(None, False)
        if len(hot) > 1:
            bitmap = bitmap | self._repeated(hot, True)[0]
        return bitmap, hot

    def firsts(self, shared) -> DataFrame:
        """Packed first place of every segment with a marked anchor, one row for each bucket."""
        each, bits, by_doc = _segmented(self.text_col, self.method.segments), np.uint64(self.bits), self.method.by_doc

        def combined(held):
            bucket, data = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((data["at"], data["key"], data["doc"], data["name"], bucket))
            bucket, data = bucket[order], data[order]
            new = np.append(True, (data["name"][1:] != data["name"][:-1]) | (bucket[1:] != bucket[:-1]))
            return bucket[new], data[new]

        def run(batches):
            marks, hot = shared.value
            held, many = [], 0
            for part, _, s in each(batches, hot):
                s = s.of(holds(marks, s.anchor))
                if not len(s.text):
                    continue
                data = np.empty(len(s.text), _FIRST)
                data["anchor"], data["name"], data["at"] = (s.anchor << bits) >> np.uint64(32), s.name, s.start
                data["doc"] = part.column("doc_id").fill_null(0).to_numpy()[s.text]
                data["key"] = part.column("_key").to_numpy()[s.text]
                if by_doc:
                    data["key"], data["at"] = 0, 0
                held.append(((s.anchor >> (np.uint64(64) - bits)).astype(np.int64), data))
                many += len(data)
                if many > HELD:
                    held = [combined(held)]
                    many = len(held[0][0])
                    if many > HELD // 2:  # little to combine
                        for b, own in _parts(held[0][0]):
                            yield _row(_FIRSTS, b, held[0][1][own])
                        held, many = [], 0
            if held:
                bucket, data = combined(held)
                for b, own in _parts(bucket):
                    yield _row(_FIRSTS, b, data[own])

        def finish(bucket, held):
            data = np.concatenate([_array(r["data"], _FIRST) for r in held])
            yield _row(_FIRSTS, bucket, combined([(np.zeros(len(data), np.int64), data)])[1])

        sent = self.read().mapInArrow(run, _ROW)
        return materialise(_dealt(sent).mapInArrow(lambda batches: _by_bucket(batches, finish), _ROW), "firsts")

    def first_marks(self, firsts: DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
        """Bitmaps of the first places, and of those whose anchor has other segments (None
        if all go through an index)."""
        by_doc = self.method.by_doc

        def keys(batches, every):
            for batch in batches:
                for r in batch.to_pylist():
                    d = _array(r["data"], _FIRST)
                    if not every:
                        _, number, count = np.unique(d["anchor"], return_inverse=True, return_counts=True)
                        d = d[count[number] > 1]
                    a = _place_hash(d["name"], d["doc"], d["key"], d["at"], by_doc)
                    yield a, np.zeros(len(a), np.int64)

        def bitmap(every):
            return repeated(firsts, lambda batches: keys(batches, every), hot=1 << 62, every=True, bits=self.wide)[0]

        return bitmap(True), None if self.method.alone else bitmap(False)

    def sent(self, shared) -> DataFrame:
        """Packed places that may be the first of their segment, with the bytes of their units."""
        each, bits, by_doc = _segmented(self.text_col, self.method.segments), np.uint64(self.bits), self.method.by_doc

        def flush(held, pieces):
            bucket, data = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(bucket, kind="stable")
            data = data[order]
            for b, own in _parts(bucket[order]):
                yield _row(_SENDS, b, data[own], b"".join(pieces[i] for i in order[own].tolist()))

        def run(batches):
            marks, hot, firsts, wanted = shared.value
            held, pieces = [], []
            for part, texts, s in each(batches, hot):
                s = s.of(holds(marks, s.anchor))
                doc = part.column("doc_id").fill_null(0).to_numpy()[s.text]
                key = part.column("_key").to_numpy()[s.text]
                h = _place_hash(s.name, doc, key.astype(np.uint32), s.start, by_doc)
                on = holds(firsts, h)
                s, doc, key, h = s.of(on), doc[on], key[on], h[on]
                if not len(s.text):
                    continue
                data = np.empty(len(s.text), _SENT)
                data["anchor"], data["name"], data["at"], data["n"] = (s.anchor << bits) >> np.uint64(32), s.name, s.start, s.count
                data["doc"], data["key"], data["bytes"] = doc, key, s.hi - s.lo
                once = np.zeros(len(s.text), bool)  # the bytes of a segment go once for a document of a slice
                once[np.unique(h, return_index=True)[1]] = True
                if not by_doc:
                    once[:] = True
                if wanted is not None:
                    once &= holds(wanted, h)
                data["bytes"][~once] = 0
                held.append(((s.anchor >> (np.uint64(64) - bits)).astype(np.int64), data))
                pieces += [texts[k][a:b] if o else b"" for k, a, b, o in zip(s.text.tolist(), s.lo.tolist(), s.hi.tolist(), once.tolist())]
                if len(pieces) > HELD // 3:
                    yield from flush(held, pieces)
                    held, pieces = [], []
            if held:
                yield from flush(held, pieces)

        return self.read().mapInArrow(run, _ROW)

    def solved(self, firsts: DataFrame, sent: DataFrame) -> DataFrame:
        """Packed spans: of first places what their index finds before them, of others all."""
        bits, method = self.bits, self.method
        length, limit = method.length, method.index_units or INDEX_UNITS

        def finish(bucket, held):
            known = [_array(r["data"], _FIRST) for r in held if r["kind"] == _FIRSTS]
            if not known or not any(r["kind"] == _SENDS for r in held):
                return
            known = np.concatenate(known)  # sorted by name
            data, pieces = [], []
            for r in held:
                if r["kind"] == _SENDS:
                    own = _array(r["data"], _SENT)
                    end = np.cumsum(own["bytes"], dtype=np.int64)
                    pieces += [r["bytes"][a:b] for a, b in zip((end - own["bytes"]).tolist(), end.tolist())]
                    data.append(own)
            data = np.concatenate(data)
            order = np.lexsort((data["at"], data["key"], data["doc"], data["name"], data["anchor"]))
            data = data[order]
            # equal rows send the same place more than once
            same = ["name", "doc", "key", "at"]
            new = np.append(True, np.logical_or.reduce([data[c][1:] != data[c][:-1] for c in same])) if len(data) else np.empty(0, bool)
            data, order = data[new], order[new]
            k = np.minimum(np.searchsorted(known["name"], data["name"]), len(known) - 1)
            first = np.logical_and.reduce([known[c][k] == data[c] for c in (same[:2] if method.by_doc else same)])
            late = data[~first]
            yield from _packed_spans(late["doc"], late["key"], late["at"], late["n"].astype(np.int64) + (length - 1), bits)
            data, order = data[first], order[first]
            # one piece of each segment; segments without bytes are alone at their anchor
            size = np.array([len(pieces[i]) for i in order.tolist()], np.int64)
            segment = np.cumsum(np.append(False, data["name"][1:] != data["name"][:-1])) if len(data) else np.empty(0, np.int64)
            own = np.flatnonzero(size > 0)
            own = own[np.unique(segment[own], return_index=True)[1]]
            units = np.cumsum(data["n"][own].astype(np.int64) + (length - 1))
            anchor = data["anchor"][own]
            lo = 0
            while lo < len(own):
                hi = int(np.searchsorted(units, (units[lo - 1] if lo else 0) + limit, side="right"))
                hi = int(np.searchsorted(anchor, anchor[min(max(hi, lo + 1), len(own)) - 1], side="right"))
                yield from _indexed(data, segment, own[lo:hi], [pieces[i] for i in order[own[lo:hi]].tolist()])
                lo = hi

        def _indexed(data, segment, own, pieces):
            # documents in order: (doc, key) as one number
            first = data[own]
            row = np.lexsort((first["key"], first["doc"]))
            new = first["doc"][row][1:] != first["doc"][row][:-1]
            if not method.by_doc:
                new |= first["key"][row][1:] != first["key"][row][:-1]
            number = np.empty(len(first), np.int64)
            number[row] = np.cumsum(np.append(0, new))
            piece, window = method.repeats(pieces, number, first["at"].astype(np.int64))
            if not len(piece):
                return
            new = np.append(True, (piece[1:] != piece[:-1]) | (window[1:] != window[:-1] + 1))
            last = np.append(np.flatnonzero(new)[1:], len(piece)) - 1
            piece, start, size = piece[new], window[new], window[last] - window[new] + length
            # every place of the segment in its first document
            lo = np.searchsorted(segment, segment[own][piece])
            n = np.searchsorted(segment, segment[own][piece], side="right") - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, size = np.repeat(start, n), np.repeat(size, n)
            yield from _packed_spans(data["doc"][at], data["key"][at], data["at"][at] + start, size, bits)

        both = firsts.union(sent)
        return materialise(_dealt(both).mapInArrow(lambda batches: _by_bucket(batches, finish), _ROW), "spans")

    def cut(self, spans: DataFrame, shared) -> DataFrame:
        """The rows with the columns of the method. Texts with spans from an index travel to
        them; the others, told by a bitmap, are finished where they are read."""
        method, text_col, bits = self.method, self.text_col, self.bits
        length = method.length

        def keys(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    d = _array(r["data"], _SPAN)
                    a = np.unique(_row_hash(d["doc"], d["key"]))
                    yield a, np.zeros(len(a), np.int64)

        wanted = self.spark.sparkContext.broadcast(repeated(spans, keys, hot=1 << 62, every=True, bits=self.wide)[0])
        added = [name for name, _ in method.fields]
        kept = [f for f in self.docs.schema.fields if f.name not in added and f.name != "_key"]
        names = [f.name for f in kept]
        schema = T.StructType(kept + [T.StructField(n, t) for n, t in method.fields])
        rows = self.docs.select(*[F.col(f"`{n}`") for n in names], F.xxhash64(text_col).bitwiseAND(F.lit(0xFFFFFFFF)).alias("_key"))

        def ids(batch):
            doc = batch.column("doc_id").cast(pa.int64())
            return doc.fill_null(0).to_numpy(zero_copy_only=False), batch.column("_key").to_numpy().astype(np.uint32), doc.is_valid().to_numpy(zero_copy_only=False)

        def finished(batch, spans_of):
            """``batch`` with its columns added; ``spans_of``: spans from an index, or None, of each row."""
            marks, hot, firsts, _ = shared.value
            done = 0
            for part in slices(batch, text_col, SLICE):
                doc, key, valid = ids(part)
                texts = texts_bytes(part, text_col)
                s = method.segments([t if v else b"" for t, v in zip(texts, valid.tolist())], hot)
                s = s.of(holds(marks, s.anchor))
                s = s.of(~holds(firsts, _place_hash(s.name, doc[s.text], key[s.text], s.start, method.by_doc)))
                edge = np.searchsorted(s.text, np.arange(len(texts) + 1)).tolist()
                stop = s.start + s.count + (length - 1)
                spans = []
                for i in range(len(texts)):
                    a, b = s.start[edge[i]:edge[i + 1]], stop[edge[i]:edge[i + 1]]
                    if (more := spans_of[done + i]) is not None:
                        a, b = np.concatenate([a, more["start"]]), np.concatenate([b, more["start"].astype(np.int64) + more["size"]])
                    spans.append((a, b) if len(a) else None)
                done += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + method.finish(texts, spans), names=[*names, *added])

        def untouched(batches):
            for batch in batches:
                doc, key, valid = ids(batch)
                batch = batch.filter(pa.array(~(holds(wanted.value, _row_hash(doc, key)) & valid)))
                yield from finished(batch, [None] * len(batch))

        own = ["_key", "_bucket", "_kind", "_spans"]
        dealt = T.StructType(rows.schema.fields + [T.StructField("_bucket", T.IntegerType()), T.StructField("_kind", T.IntegerType()),
                                                   T.StructField("_spans", T.BinaryType())])

        def having(batches):
            for batch in batches:
                doc, key, valid = ids(batch)
                h = _row_hash(doc, key)
                on = holds(wanted.value, h) & valid
                batch, bucket = batch.filter(pa.array(on)), (h[on] >> np.uint64(64 - bits)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(bucket), pa.array(np.ones(len(bucket), np.int32)), pa.nulls(len(bucket), pa.binary())],
                    names=[*names, *own])

        def touched(batches):
            bucket, parts, table = None, [], {}
            for batch in batches:
                kinds, buckets = batch.column("_kind").to_pylist(), batch.column("_bucket").to_pylist()
                doc, key, _ = ids(batch)
                found, on = [], []
                for i, (kind, b) in enumerate(zip(kinds, buckets)):
                    if b != bucket:
                        bucket, parts, table = b, [], None
                    if kind == 0:
                        parts.append(_array(batch.column("_spans")[i].as_py(), _SPAN))
                        continue
                    if table is None:
                        table, parts = _by_row(parts), []
                    on.append(i)
                    found.append(table.get((int(doc[i]), int(key[i]))))
                if on:
                    yield from finished(batch.take(pa.array(on)), found)

        spans_rows = spans.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kept], F.lit(0).cast("long").alias("_key"),
                                  F.col("bucket").alias("_bucket"), F.lit(0).alias("_kind"), F.col("data").alias("_spans"))
        some = spans_rows.union(rows.mapInArrow(having, dealt)).repartition("_bucket").sortWithinPartitions("_bucket", "_kind")
        return some.mapInArrow(touched, schema).union(rows.mapInArrow(untouched, schema))


def _by_row(parts: list) -> dict:
    """Spans of each (doc, key)."""
    if not parts:
        return {}
    data = np.concatenate(parts)
    data = data[np.lexsort((data["key"], data["doc"]))]
    new = np.flatnonzero(np.append(True, (data["doc"][1:] != data["doc"][:-1]) | (data["key"][1:] != data["key"][:-1])))
    return {(int(data["doc"][lo]), int(data["key"][lo])): data[lo:hi] for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(data)])}


def covered(spans, n: int) -> np.ndarray | None:
    """Which of ``n`` units the spans (starts, ends) cover; None without spans."""
    if spans is None:
        return None
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, spans[0], 1)
    np.add.at(mark, np.minimum(spans[1], n), -1)
    return np.cumsum(mark)[:n] > 0


def run(docs: DataFrame, method: Method, text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``docs`` with the columns of ``method``."""
    search = Search(docs, method, text_col, hot)
    share = search.spark.sparkContext.broadcast
    marks, often = search.anchors()
    firsts = search.firsts(share((marks, often)))
    shared = share((marks, often, *search.first_marks(firsts)))
    spans = search.solved(firsts, search.sent(shared))
    return search.cut(spans, shared)
