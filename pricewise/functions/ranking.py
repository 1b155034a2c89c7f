"""Seeded hashing and distributed ranking.

All randomness is ``md5(seed | salt | key)``: it does not depend on the
partitioning, survives task retries unchanged, and DuckDB has ``md5`` too.

Global order without a one-task window
--------------------------------------
``row_number() over (order by x)`` with no partition runs in a single task.
``global_row_number`` instead range-partitions by the order, sorts inside each
partition, numbers rows locally and adds the row count of all earlier
partitions. The per-partition counts table has one row per partition (a
proven size bound), so it is broadcast. Range partitioning samples the keys,
so a value shared by many rows cannot pile into one task unless the order key
itself is not unique; callers always end the order with a unique key.

The numbered partitions are written once with a reliable ``checkpoint()``
(to the cluster's checkpoint folder): the counts and the rows then come from
the same materialisation, so a recomputation after an executor loss cannot
number rows against offsets from a different range sample.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def seeded_hash(seed: int | str, *parts: Column | str, salt: str = "") -> Column:
    """md5 hex of ``seed|salt|part1|part2…``; a uniform, reproducible sort key."""
    cols = [F.lit(str(seed)), F.lit(salt)] + [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def global_row_number(
    df: DataFrame,
    order_cols: Sequence[str],
    out: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based row number over a total order, computed without a global window.

    ``order_cols`` must be ascending and end with a unique key (ties would make
    the numbering depend on the sort's stability).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    # monotonically_increasing_id = (partition id << 33) + row position inside the partition
    tagged = ordered.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ).checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, subset=["_off"])
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_off") + F.col("_local") + F.lit(1))
        .drop("_pid", "_local", "_off")
    )


#: Rows of a hash bucket that may be read to find a cut, and of all brackets in one pass.
LEAF_ROWS, BRACKET_ROWS = 2_000, 200_000
_DIGITS, _FINE = 3, 12


def hash_cuts(df: DataFrame, hash_col: str, key: str, ranks_of, group: str | None = None, sizes: dict | None = None) -> dict:
    """The rows that hold given ranks in the order of (hash, key), per group, without
    moving a row: ``{group: [(hash, key) of each rank]}``.

    ``ranks_of(group, n)`` gives the 1-based ranks wanted in a group of ``n`` rows.
    A seeded hash is uniform, so rank r of n rows stands at the share r / n of the hash's
    range, give or take a few deviations: where ``sizes`` (rows of each group) is known,
    one pass counts the rows below each such bracket and reads those inside it. Without
    ``sizes`` a first pass counts the groups. Should a rank be outside its bracket, or the
    brackets hold more than ``BRACKET_ROWS`` rows, buckets of the hash are counted instead
    (``_cuts_by_buckets``). A caller compares rows with the cut: no sort, no shuffle.
    """
    g = F.col(group) if group else F.lit(0)
    rows = df.select(g.alias("_g"), F.col(hash_col).alias("_hash"), F.col(key).alias("_key"))
    if sizes is None:
        sizes = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = {k: list(ranks_of(k, n)) for k, n in sizes.items() if n}
    ends = {k: [_share(r, sizes[k]) for r in rs] for k, rs in ranks.items() if rs}
    expected = sum((hi - lo) / 16 ** _FINE * sizes[k] for k, own in ends.items() for lo, hi in own)
    if ends and expected <= BRACKET_ROWS:
        found = _cuts_by_brackets(rows, ranks, ends)
        if found is not None:
            return {k: found.get(k, []) for k in ranks}
    return _cuts_by_buckets(rows, ranks)


def _share(rank: int, n: int) -> tuple[int, int]:
    """Bracket of the hash's leading digits that holds rank ``rank`` of ``n``, with all but no doubt."""
    whole = 16 ** _FINE
    if n <= LEAF_ROWS:
        return 0, whole
    p = rank / n
    wide = 9.0 * (p * (1 - p) / n) ** 0.5 + 30.0 / n
    return max(0, int((p - wide) * whole)), min(whole, int((p + wide) * whole) + 1)


def _cuts_by_brackets(rows: DataFrame, ranks: dict, ends: dict) -> dict | None:
    digits = F.substring("_hash", 1, _FINE)
    most = max(map(len, ends.values()))
    text = lambda x: format(x, f"0{_FINE}x") if x < 16 ** _FINE else "g"  # noqa: E731  'g' is beyond all digits
    inside, below = F.lit(False), [F.lit(0)] * most
    for k, own in ends.items():
        mine = F.col("_g").eqNullSafe(F.lit(k))
        for j, (lo, hi) in enumerate(own):
            inside = inside | (mine & (digits >= text(lo)) & (digits < text(hi)))
            below[j] = F.when(mine, (digits < text(lo)).cast("int")).otherwise(below[j])
    found = (rows.groupBy("_g", F.when(inside, F.struct("_hash", "_key")).alias("_x"))
             .agg(F.count(F.lit(1)).alias("_n"), *[F.sum(b).alias(f"_b{j}") for j, b in enumerate(below)]).collect())
    out: dict = {}
    for k, own in ends.items():
        mine = [r for r in found if r["_g"] == k]
        held = sorted(((r["_x"]["_hash"], r["_x"]["_key"], r["_n"]) for r in mine if r["_x"] is not None),
                      key=lambda x: (x[0], x[1] is not None, x[1]))
        cuts = []
        for j, (rank, (lo, hi)) in enumerate(zip(ranks[k], own)):
            cut = _at(held, text(lo), text(hi), rank - sum(r[f"_b{j}"] for r in mine))
            if cut is None:
                return None
            cuts.append(cut)
        out[k] = cuts
    return out


def _at(held: list, lo: str, hi: str, left: int) -> tuple | None:
    """The row with 1-based rank ``left`` among the sorted (hash, key, rows) of a bracket; None if it is outside."""
    if left <= 0:
        return None
    for h, v, n in held:
        if lo <= h[:_FINE] < hi:
            left -= n
            if left <= 0:
                return h, v
    return None


def _cuts_by_buckets(rows: DataFrame, ranks: dict) -> dict:
    """Rows are counted by the first hexadecimal digits of the hash (partial aggregation, a
    few thousand counts); the bucket of each rank is counted again by three more digits until
    it is small, and only its rows are read."""

    def counted(source: DataFrame, digits: int) -> dict:
        out: dict = {}
        agg = source.groupBy("_g", F.substring("_hash", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        for r in agg.collect():
            out.setdefault(r["_g"], []).append((r["_p"], r["_n"]))
        return {k: sorted(v) for k, v in out.items()}

    def locate(buckets: list, rank: int) -> tuple[str, int, int]:
        for prefix, n in buckets:
            if rank <= n:
                return prefix, rank, n
            rank -= n
        raise ValueError("rank beyond the rows")

    digits = _DIGITS
    top = counted(rows, digits)
    at = {(k, r): locate(top[k], r) for k, rs in ranks.items() for r in rs}
    while any(n > LEAF_ROWS for _, _, n in at.values()) and digits < 32:
        digits += _DIGITS
        open_ = {(k, p) for (k, _), (p, _, n) in at.items() if n > LEAF_ROWS}
        deeper = counted(rows.where(_in_buckets(open_)), digits)
        at = {(k, r): locate([b for b in deeper[k] if b[0].startswith(p)], left) if n > LEAF_ROWS else (p, left, n)
              for (k, r), (p, left, n) in at.items()}
    found: dict = {}
    if at:
        leaves = {(k, p) for (k, _), (p, _, _) in at.items()}
        for r in rows.where(_in_buckets(leaves)).collect():
            found.setdefault(r["_g"], []).append((r["_hash"], r["_key"]))
    out: dict = {k: [] for k in ranks}
    for (k, r), (p, left, _) in at.items():
        own = sorted((x for x in found[k] if x[0].startswith(p)), key=lambda x: (x[0], x[1] is not None, x[1]))
        out[k].append(own[left - 1])
    return out


def _in_buckets(buckets: set) -> Column:
    """Rows of the given (group, hash prefix) buckets."""
    any_ = F.lit(False)
    for k, p in sorted(buckets):
        any_ = any_ | ((F.col("_g") == F.lit(k)) & F.col("_hash").startswith(p))
    return any_


def not_after(hash_col: str, key: str, cut: Column) -> Column:
    """Is a row at or before a cut (a struct of hash and key) in the order of (hash, key)?
    Structs compare field by field, nulls first; the row's hash and key are named once."""
    return F.struct(F.col(hash_col).alias("h"), F.col(key).alias("k")) <= cut


def cut_struct(cut: tuple, key_type: str) -> Column:
    """A cut of ``hash_cuts`` as a literal struct."""
    return F.struct(F.lit(cut[0]).alias("h"), F.lit(cut[1]).cast(key_type).alias("k"))
