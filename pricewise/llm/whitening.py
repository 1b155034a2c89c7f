"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of the covariance are found without forming it. A block of
``BLOCK`` directions is held; a *pass* multiplies it by the covariance in one Spark job
(every task sums ``X'(XQ)`` of its centred rows, the sums meet by row of the result).
A Chebyshev polynomial of the covariance, evaluated by its three-term recurrence over
such passes, damps the spectrum below the block's smallest Ritz value; QR and
Rayleigh-Ritz follow. Rounds go on until every wanted pair is certified: the norm of
``Vq - eq`` is below ``TOLERANCE`` times the largest eigenvalue.

Entries are put on a grid, ``x = floor(64 c) + 1000000``, so that counts, sums and
deviations are exact whatever the partitioning. The covariance is that of the fit list,
which has each distinct ``x`` vector once.

Defined results. Rows whose vector is null, empty, or has a null or non-finite entry are
dropped, and so are rows with an entry of 2**56 or more, which 64 bits cannot hold on the grid.
Of several vector lengths the most frequent one (of equals the longest) is kept.
An empty table gives no rows. Components without variance (at most ``FLAT`` of the
largest eigenvalue) have no whitened value and no rows: a single distinct vector gives
none. Rows with the same id are separate rows. ``deviation`` is null where it passes 64 bits.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_broadcast, materialise

GRID, SHIFT = 64, 1_000_000
#: Entries from here on do not fit the grid.
LARGEST = 2.0 ** 56
COMPONENTS = 16
BLOCK = 48
DEGREE = 10
TOLERANCE = 1e-13
FLAT = 1e-12
ROUNDS = 200
#: Rows of a packed block of the fit list.
PACK = 4096
#: Entries of a block of directions that may be broadcast (dimensions x ``BLOCK``).
WIDEST = 1 << 21
_INT64 = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Whitening:
    """Fitted components: ``vectors`` has a unit eigenvector in each column."""

    n: int
    sums: tuple
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    residual: float
    passes: int

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def on_grid(vector: Column) -> Column:
    """A vector's entries as long; null unless all entries are finite numbers that the grid holds."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    fine = (F.size(vector) > 0) & F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    return F.when(fine, F.transform(entry, lambda c: F.floor(c * F.lit(float(GRID))) + F.lit(SHIFT).cast("long")))


def usable(rows: DataFrame, vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(``rows`` with the column ``_x`` of grid vectors, dimensions)."""
    found = rows.withColumn("_x", on_grid(F.col(f"`{vector_col}`"))).where("_x IS NOT NULL")
    sizes = found.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).take(1)
    d = sizes[0]["d"] if sizes else 0
    return found.where(F.size("_x") == d), d


def fit_list(found: DataFrame, d: int) -> DataFrame:
    """Each distinct grid vector once, in packed blocks (``data``: rows of ``d`` int64).
    ``distinct`` combines within tasks first, so a vector that many rows have costs nothing."""

    def pack(batches):
        for batch in batches:
            x = batch.column("_x")
            flat = x.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, d)
            for lo in range(0, len(flat), PACK):
                yield pa.RecordBatch.from_arrays([pa.array([flat[lo:lo + PACK].tobytes()], pa.binary())], names=["data"])

    return materialise(found.select("_x").distinct().mapInArrow(pack, "data binary"), "fit-list")


def _blocks(batches, d: int):
    for batch in batches:
        for blob in batch.column("data"):
            yield np.frombuffer(blob.as_py(), "<i8").reshape(-1, d)


def _total(blocks: DataFrame, d: int, width: int, work) -> np.ndarray:
    """Sum over all tasks of the (rows, ``width``) arrays that ``work(iterator of
    blocks)`` returns; summed by row in a shuffle, so the driver gets one array."""

    def run(batches):
        out = work(_blocks(batches, d))
        if out is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(out), dtype=np.int32)), *[pa.array(np.ascontiguousarray(out[:, j])) for j in range(width)]],
                names=["_row", *[f"c{j}" for j in range(width)]])

    schema = "_row int, " + ", ".join(f"c{j} double" for j in range(width))
    sums = (blocks.mapInArrow(run, schema).groupBy("_row").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect())
    out = np.zeros((max((r[0] for r in sums), default=-1) + 1, width))
    for r in sums:
        out[r[0]] = r[1:]
    return out


def _exact_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sum of every dimension)."""

    def run(batches):
        n, total = 0, None
        for x in _blocks(batches, d):
            n += len(x)
            wide = np.abs(x).max(initial=0) > _INT64 // (2 * PACK)  # beyond it 64 bits could overflow
            part = [int(v) for v in (x.astype(object) if wide else x).sum(axis=0)]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            rows = [-1, *range(d)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["dim", "total"])

    sums = {r["dim"]: int(r["total"]) for r in blocks.mapInArrow(run, "dim int, total string")
            .groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(d)]


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``x - S/n``: the whole part of the mean is taken away as integers, so no digits are lost."""
    return (x - whole).astype(np.float64) - rest


def fit(blocks: DataFrame, d: int, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE,
        tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 7) -> Whitening:
    """The leading components of the covariance of the packed rows in ``blocks``."""
    width = min(block, d)
    check_broadcast(d * width, WIDEST, "directions")
    n, sums = _exact_sums(blocks, d) if d else (0, [])
    if not n:
        return Whitening(0, tuple(sums), np.empty(0), np.empty((d, 0)), 0.0, 0.0, 0.0, 0)
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``: one pass."""
        nonlocal passes
        passes += 1
        k = q.shape[1]

        def work(parts):
            total = None
            for x in parts:
                y = _centred(x, whole, rest)
                part = y.T @ (y @ q)
                total = part if total is None else total + part
            return total

        return _total(blocks, d, k, work) / n

    def squares(parts):
        total = np.zeros((1, 1))
        for x in parts:
            total += (_centred(x, whole, rest) ** 2).sum()
        return total

    trace = float(_total(blocks, d, 1, squares)[0, 0]) / n
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))
    wanted = min(components, width)
    values, residual = np.zeros(width), np.inf
    best = None
    for _ in range(rounds):
        vq = apply(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        norms = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        top = max(float(values[0]), 0.0)
        live = values[:wanted] > FLAT * top
        residual = float(norms[live].max(initial=0.0) / top) if top > 0 else 0.0
        if best is None or residual < best[0]:
            best, stale = (residual, values.copy(), q.copy()), 0
        else:
            stale += 1
        if residual <= tolerance or width == d or stale >= 3 and residual < 1e-11:
            break
        q = _filtered(apply, q, vq, max(float(values[-1]), 0.0), top, degree)
        q, _ = np.linalg.qr(q)
    residual, values, q = best
    if residual > 1e-9:
        raise ValueError(f"not certified after {rounds} rounds: residual {residual:.1e}")
    keep = int((values[:wanted] > FLAT * max(float(values[0]), 0.0)).sum()) if values[0] > 0 else 0
    values, q = values[:keep].copy(), q[:, :keep].copy()

    def cross(parts):
        total = None
        for x in parts:
            w = (_centred(x, whole, rest) @ q) / np.sqrt(values)
            part = w.T @ w
            total = part if total is None else total + part
        return total

    error = float(np.abs(_total(blocks, d, keep, cross) / n - np.eye(keep)).max()) if keep else 0.0
    return Whitening(n, tuple(sums), values, q, trace, error, residual, passes)


def _filtered(apply, q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance times ``q``: small on [0, ``cut``], scaled
    to 1 at ``top``. ``vq`` is the covariance times ``q`` already, the first step."""
    if not 0 < cut < top:
        return vq
    centre = half = cut / 2
    sigma = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(1, degree):
        after = 1.0 / (2.0 / first - sigma)
        step = (apply(now) - centre * now) * (2.0 * after / half) - before * (sigma * after)
        before, now, sigma = now, step, after
    return now


def whiten(found: DataFrame, model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for
    every row of ``found`` and every component of the model."""
    d, k, n = model.dimensions, len(model.values), model.n
    schema = T.StructType([
        T.StructField(id_col, dict((f.name, f.dataType) for f in found.schema.fields)[id_col]), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    if not k:
        return found.sparkSession.createDataFrame([], schema)
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        whole = np.array([s // n for s in m.sums], dtype=np.int64)
        left = np.array([s % n for s in m.sums], dtype=object)
        small = left.astype(np.int64) if n < 1 << 62 else None
        scale = m.vectors / np.sqrt(m.values)
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            y = x - whole
            w = (y.astype(np.float64) - (left / n).astype(np.float64)) @ scale
            # n x - S = n (x - whole) - left
            far = (n * np.abs(y).astype(np.float64) + n) ** 2
            safe = (far.sum(axis=1) < 2.0 ** 62) if small is not None else np.zeros(len(y), bool)
            dev = np.zeros(len(y), dtype=np.int64)
            gap = n * y[safe] - small if small is not None else None
            if gap is not None:
                dev[safe] = (gap * gap).sum(axis=1)
            null = np.zeros(len(y), bool)
            for i in np.flatnonzero(~safe):
                exact = sum((n * int(a) - int(b)) ** 2 for a, b in zip(y[i].tolist(), left))
                null[i] = exact > _INT64
                dev[i] = 0 if null[i] else exact
            rows = len(y) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(np.repeat(np.arange(len(y)), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                 pa.array(np.full(rows, n, np.int64)), pa.array(np.repeat(dev, k), mask=np.repeat(null, k)),
                 pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace, len(y))),
                 pa.array(np.full(rows, m.identity_error))], names=schema.names)

    return found.select(id_col, "_x").mapInArrow(run, schema)


def whitened(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors of ``rows`` and whiten every usable row."""
    found, d = usable(rows.select(id_col, vector_col), vector_col)
    return whiten(found, fit(fit_list(found, d), d, components), id_col)
