"""Statistics helpers: exact quantiles at scale, normal quantile, finite check.

Exact quantiles
---------------
``percentile`` keeps every distinct value of the column on one reducer, which
does not survive 100 TB. ``ranked_quantiles`` gets the same numbers (NumPy's
default linear interpolation) in two passes shared by all columns: a mergeable summary
brackets each wanted rank, and one aggregate counts what is below and inside the brackets.
Very large columns, whose brackets would hold too many values for the driver, are cut
into ``BUCKETS`` parts instead, again and again, until a part holds one distinct value.
"""
from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Accuracy of the summary: a rank is off by at most one part in so many.
SUMMARY = 10_000
#: Columns of at most so many values are counted whole; others by brackets that hold at most so many rows.
SMALL, MOST_INSIDE = 20_000, 400_000
#: More ranks than this have brackets a tenth as wide, and rows find theirs by binary search.
FEW_RANKS = 16


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    """NaN and ±inf become null at the edge (the reference drops both)."""
    return F.when(is_finite(c), c)


def _order_stat_targets(n: int, probs: Sequence[float]) -> list[tuple[float, int, int, float]]:
    out = []
    for q in probs:
        pos = (n - 1) * q
        lo = math.floor(pos)
        hi = min(lo + 1, n - 1)
        out.append((q, lo, hi, pos - lo))
    return out


@dataclass(frozen=True)
class Quantiles:
    """Exact quantiles of a column: their values, finite rows below each, finite rows, all rows."""

    values: list[float]
    below: list[int]
    n: int
    rows: int


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float] | None:
    """Linear-interpolated quantiles over the finite values of ``col`` (None if there are none)."""
    return exact_quantiles_multi(df, {col: F.col(col)}, probs)[col]


def exact_quantiles_multi(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of several columns, in passes shared by all of them."""
    return {c: q.values if q.n else None for c, q in ranked_quantiles(df, columns, probs).items()}


def ranked_quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float]) -> dict[str, Quantiles]:
    """Exact quantiles of several columns, with the number of rows below each, in two passes.

    The first finds a bracket of each wanted rank from a mergeable summary
    (``percentile_approx``, whose rank error is bounded). The second counts, in one
    aggregate, the rows below each bracket and the values inside it. A summary that does
    not keep its bound, and columns whose brackets would hold more than ``MOST_INSIDE``
    rows, go on in buckets (``_bucketed``)."""
    names = list(columns)
    vals = df.select(*[finite_or_null(columns[c].cast("double")).alias(f"c{i}") for i, c in enumerate(names)])
    qs = sorted(set(probs))
    summary = SUMMARY if len(qs) <= FEW_RANKS else 10 * SUMMARY
    margin = 2.0 / summary
    wide = [x for q in qs for x in (max(0.0, q - margin), min(1.0, q + margin))]
    stats = vals.agg(F.count(F.lit(1)).alias("rows"), *[x for i in range(len(names)) for x in (
        F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"),
        F.percentile_approx(f"c{i}", wide, summary).alias(f"q{i}"))]).first()
    out: dict[str, Quantiles] = {}
    brackets: dict[int, list[tuple[float, float]]] = {}
    slow: list[int] = []
    for i, c in enumerate(names):
        n = stats[f"n{i}"]
        if not n:
            out[c] = Quantiles([], [], 0, stats["rows"])
        elif n <= SMALL:
            brackets[i] = [(stats[f"lo{i}"], stats[f"hi{i}"])]
        elif n * 2 * margin * len(qs) > MOST_INSIDE:
            slow.append(i)
        else:
            found = list(stats[f"q{i}"])
            pairs = list(zip(found[::2], found[1::2]))
            brackets[i] = [(stats[f"lo{i}"] if q - margin <= 0 else a, stats[f"hi{i}"] if q + margin >= 1 else b)
                           for q, (a, b) in zip(qs, pairs)]
    counts = _inside(vals, brackets)
    for i in brackets:
        got = _from_brackets(stats[f"n{i}"], probs, *counts[i])
        if got is None:
            slow.append(i)
        else:
            out[names[i]] = Quantiles(*got, stats[f"n{i}"], stats["rows"])
    for i in slow:
        out[names[i]] = _counted(vals, f"c{i}", _bucketed(vals, f"c{i}", stats[f"n{i}"], stats[f"lo{i}"], stats[f"hi{i}"], probs), stats)
    return {c: out[c] for c in names}


def _inside(vals: DataFrame, brackets: dict[int, list]) -> dict[int, tuple[list, list]]:
    """Per column: [(bracket's low end, rows below it)], [(value, rows) inside the brackets]."""
    if not brackets:
        return {}
    most = max(map(len, brackets.values()))
    if most > FEW_RANKS:
        return _inside_many(vals, brackets)
    cells = []
    for i, own in brackets.items():
        v = F.col(f"c{i}")
        inside = F.lit(False)
        for lo, hi in own:
            inside = inside | v.between(lo, hi)
        below = [(v < F.lit(lo)).cast("int") for lo, _ in own] + [F.lit(0)] * (most - len(own))
        cells.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("i"), F.when(inside, v).alias("v"), *[b.alias(f"b{k}") for k, b in enumerate(below)])))
    rows = vals.select(F.explode(F.array(*cells)).alias("x")) if len(cells) > 1 else vals.select(cells[0].alias("x"))
    found = (rows.where("x IS NOT NULL").groupBy("x.i", "x.v")
             .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"x.b{k}").alias(f"b{k}") for k in range(most)]).collect())
    out: dict[int, tuple[list, list]] = {}
    for i, own in brackets.items():
        mine = [r for r in found if r["i"] == i]
        out[i] = ([(lo, sum(r[f"b{k}"] for r in mine)) for k, (lo, _) in enumerate(own)],
                  sorted((r["v"], r["n"]) for r in mine if r["v"] is not None))
    return out


def _inside_many(vals: DataFrame, brackets: dict[int, list]) -> dict[int, tuple[list, list]]:
    """``_inside`` for many brackets. The low ends cut a column into parts, and a value is inside
    a bracket if it is at most the largest high end of the brackets that start at or before its
    part. Rows are counted by part and, inside, by value."""
    ends = {}
    for i, own in brackets.items():
        lows = np.array(sorted({lo for lo, _ in own}))
        ends[i] = lows, np.maximum.accumulate([max(hi for lo, hi in own if lo == x) for x in lows])

    def run(batches):
        for batch in batches:
            for i, (lows, tops) in ends.items():
                v = batch.column(f"c{i}").drop_null().to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
                part = np.searchsorted(lows, v, side="right")
                within = (part > 0) & (v <= tops[part - 1])
                n = np.bincount(part[~within], minlength=len(lows) + 1)
                values, counts = np.unique(v[within], return_counts=True)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k) + len(values), i, np.int32)),
                     pa.array(np.append(k, np.searchsorted(lows, values, side="right")).astype(np.int32)),
                     pa.array([None] * len(k) + values.tolist(), pa.float64()), pa.array(np.append(n[k], counts).astype(np.int64))],
                    names=["i", "part", "v", "n"])

    cells = vals.select(*[f"c{i}" for i in brackets]).mapInArrow(run, "i int, part int, v double, n long")
    found: dict[int, list] = {i: [] for i in brackets}
    for r in cells.groupBy("i", "part", "v").agg(F.sum("n").alias("n")).collect():
        found[r["i"]].append((r["part"], r["v"], r["n"]))
    out: dict[int, tuple[list, list]] = {}
    for i, own in brackets.items():
        lows, rows = ends[i][0], np.zeros(len(ends[i][0]) + 1, dtype=np.int64)
        for part, _, n in found[i]:
            rows[part] += n
        below = np.cumsum(rows)
        out[i] = ([(lo, int(below[np.searchsorted(lows, lo)])) for lo, _ in own], sorted((v, n) for _, v, n in found[i] if v is not None))
    return out


def _from_brackets(n: int, probs: Sequence[float], ends: list, inside: list) -> tuple[list[float], list[int]] | None:
    """(quantiles, rows below each); None where a rank is outside the brackets."""
    values = [v for v, _ in inside]

    def at(rank: int, lo: float, below: int) -> float | None:
        for k in range(bisect.bisect_left(values, lo), len(values)):
            if rank < below + inside[k][1]:
                return values[k] if rank >= below else None
            below += inside[k][1]
        return None

    out, less = [], []
    by_prob = dict(zip(sorted(set(probs)), ends)) if len(ends) > 1 else dict.fromkeys(probs, ends[0])
    for q, a, b, frac in _order_stat_targets(n, probs):
        lo, below = by_prob[q]
        x, y = at(a, lo, below), at(b, lo, below)
        if x is None or y is None:
            return None
        cut = x + (y - x) * frac if frac else x
        out.append(cut)
        less.append(below + sum(m for v, m in inside if lo <= v < cut))
    return out, less


def _counted(vals: DataFrame, col: str, cuts: list[float], stats) -> Quantiles:
    below = vals.agg(*[F.count_if(F.col(col) < F.lit(c)).alias(f"b{k}") for k, c in enumerate(cuts)]).first()
    return Quantiles(cuts, list(below), stats[f"n{col[1:]}"], stats["rows"])


def _bucketed(vals: DataFrame, col: str, n: int, low: float, high: float, probs: Sequence[float]) -> list[float]:
    """Quantiles from bucket counts: the range is cut into ``BUCKETS`` parts, rows are counted
    per part, and the part that holds a wanted rank is cut again, until it holds one value.
    Nothing but counts leaves the tasks, however often a value occurs."""
    targets = _order_stat_targets(n, probs)
    found: dict[int, float] = {}
    # (lo, hi) -> {rank: rank inside the part}
    open_ = {(low, high): {r: r for _, lo, hi, _ in targets for r in (lo, hi)}}
    while open_:
        for lo, hi in [p for p in open_ if p[0] == p[1]]:
            found.update(dict.fromkeys(open_.pop((lo, hi)), lo))
        parts = sorted(open_)
        if not parts:
            break
        v = F.col(col)
        buckets = F.explode(F.array(*[
            F.when(v.between(lo, hi), F.struct(F.lit(t).alias("t"), _bucket(v, lo, hi).alias("b"), v.alias("v")))
            for t, (lo, hi) in enumerate(parts)]))
        counts: dict[int, list] = {}
        for r in (vals.select(buckets.alias("x")).where("x IS NOT NULL").groupBy("x.t", "x.b")
                  .agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect()):
            counts.setdefault(r["t"], []).append((r["lo"], r["hi"], r["n"]))
        nxt: dict = {}
        for t, part in enumerate(parts):
            for rank, inside in open_[part].items():
                for a, b, m in sorted(counts[t]):
                    if inside < m:
                        nxt.setdefault((a, b), {})[rank] = inside
                        break
                    inside -= m
        open_ = nxt
    return [found[lo] + (found[hi] - found[lo]) * frac if frac else found[lo] for _, lo, hi, frac in targets]


def _bucket(v: Column, lo: float, hi: float) -> Column:
    """Number of the part of [lo, hi] that holds ``v``; never falls as ``v`` grows."""
    if lo > 0 and hi > 4 * lo or hi < 0 and lo < 4 * hi or lo <= 0 <= hi and max(-lo, hi) > 1e6:
        v = F.signum(v) * F.log1p(F.abs(v))
        lo, hi = (math.copysign(math.log1p(abs(x)), x) for x in (lo, hi))
    width = (hi - lo) / BUCKETS
    if not 0 < width < math.inf:  # neighbouring doubles
        return F.when(v > F.lit(lo), 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((v - F.lit(lo)) / F.lit(width)))).cast("int")


# Acklam's rational approximation of the standard normal quantile.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
      3.754408661907416e00]
_P_LOW = 0.02425


def _poly(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Inverse standard normal CDF as a column expression (|error| < 1.2e-9)."""
    q_tail = F.sqrt(F.lit(-2.0) * F.log(p))
    lower = _poly(_C, q_tail) / (_poly(_D, q_tail) * q_tail + F.lit(1.0))
    q_up = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    upper = -_poly(_C, q_up) / (_poly(_D, q_up) * q_up + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    central = _poly(_A, r) * q / (_poly(_B, r) * r + F.lit(1.0))
    return F.when(p < F.lit(_P_LOW), lower).when(p > F.lit(1 - _P_LOW), upper).otherwise(central)


def norm_ppf_sql(p: str) -> str:
    """The same approximation as SQL text (for DuckDB oracles)."""
    def poly(coefs: list[float], x: str) -> str:
        acc = repr(coefs[0])
        for c in coefs[1:]:
            acc = f"(({acc}) * ({x}) + {c!r})"
        return acc
    qt = f"sqrt(-2.0 * ln({p}))"
    qu = f"sqrt(-2.0 * ln(1.0 - ({p})))"
    q = f"(({p}) - 0.5)"
    r = f"({q} * {q})"
    return (
        f"CASE WHEN ({p}) < {_P_LOW!r} THEN ({poly(_C, qt)}) / (({poly(_D, qt)}) * {qt} + 1.0) "
        f"WHEN ({p}) > {1 - _P_LOW!r} THEN -({poly(_C, qu)}) / (({poly(_D, qu)}) * {qu} + 1.0) "
        f"ELSE ({poly(_A, r)}) * {q} / (({poly(_B, r)}) * {r} + 1.0) END"
    )


def filliben(i: Column, n: Column) -> Column:
    """Filliben's order-statistic medians for ranks i = 1..n."""
    last = F.pow(F.lit(0.5), F.lit(1.0) / n)
    first = F.lit(1.0) - last
    mid = (i - F.lit(0.3175)) / (n + F.lit(0.365))
    return F.when(i == 1, first).when(i == n, last).otherwise(mid)
