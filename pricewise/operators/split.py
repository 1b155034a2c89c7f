"""Price-stratified, seeded train / hold-out split.

Every input row lands in exactly one side (one boolean column, no second
pass). Randomness is the order of ``md5(seed | key)``, so the split is the same for
any partitioning and any number of executors.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import cut_struct, hash_cuts, not_after, seeded_hash
from ..functions.stats import exact_quantiles, is_finite, ranked_quantiles
from ..session import open_files

DEFAULT_HOLDOUT = 0.15
DEFAULT_SEED = 42
STRATUM_PROBS = (0.2, 0.4, 0.6, 0.8)
#: Values of ``split``.
SIDES = 2


def price_cuts(df: DataFrame, price_col: str = "price", probs: Sequence[float] = STRATUM_PROBS) -> list[float] | None:
    """D1 (cuts): exact linear-interpolated percentiles over finite prices."""
    return exact_quantiles(df, price_col, probs)


def assign_strata(df: DataFrame, cuts: Sequence[float] | None, price_col: str = "price") -> DataFrame:
    """stratum = number of cuts ≤ price (0–4); no finite price → −1.

    The cuts are a handful of literals, so this is a narrow projection."""
    p = F.col(price_col).cast("double")
    if not cuts:
        return df.withColumn("stratum", F.lit(-1))
    n_le = sum(F.when(p >= F.lit(c), 1).otherwise(0) for c in cuts)
    return df.withColumn("stratum", F.when(is_finite(p), n_le).otherwise(F.lit(-1)).cast("int"))


def holdout_size(n: int, size: float) -> int:
    """max(1, round-half-even(n × size))."""
    return max(1, round(n * size))


def mark_holdout(
    strata: DataFrame,
    key: str,
    size: float = DEFAULT_HOLDOUT,
    seed: int = DEFAULT_SEED,
    sizes: dict | None = None,
) -> DataFrame:
    """D2 + D3: per stratum the max(1, rint(n × size)) rows with the smallest seeded
    hash are hold-out; the rest is train. Adds ``holdout`` (boolean) and ``split``
    ('holdout'/'train'). ``sizes`` has the rows of each stratum, where they are known.

    The hold-out test is a threshold: ``hash_cuts`` finds the row that holds the last
    hold-out rank of each stratum, and each row is compared with the one of its stratum.
    Hash, key and stratum are named once, so the test is as cheap in a filter that is
    pushed below as in a column. No row is sorted or shuffled, whatever a stratum's size."""
    df = strata.withColumn("_h", seeded_hash(seed, key))
    cuts = hash_cuts(df, "_h", key, lambda _, n: [holdout_size(n, size)], group="stratum", sizes=sizes)
    kind = dict(df.dtypes)[key]
    if cuts:
        table = F.create_map(*[x for stratum, (cut,) in sorted(cuts.items()) for x in (F.lit(stratum), cut_struct(cut, kind))])
        inside = F.coalesce(not_after("_h", key, F.element_at(table, F.col("stratum"))), F.lit(False))
    else:
        inside = F.lit(False)
    return df.withColumn("holdout", inside).withColumn(
        "split", F.when(F.col("holdout"), "holdout").otherwise("train")).drop("_h")


def split(
    df: DataFrame,
    key: str,
    price_col: str = "price",
    size: float = DEFAULT_HOLDOUT,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """D1–D3 in one call, with three reads of ``df``: a summary that brackets the price
    cuts, the exact cuts and with them the sizes of the strata, the hold-out thresholds."""
    found = ranked_quantiles(df, {price_col: F.col(price_col)}, STRATUM_PROBS)[price_col]
    edge = [0, *found.below, found.n] if found.n else [0, 0]
    sizes = {k: b - a for k, (a, b) in enumerate(zip(edge, edge[1:])) if b > a} | {-1: found.rows - found.n}
    strata = assign_strata(df, found.values if found.n else None, price_col)
    return mark_holdout(strata, key, size, seed, {k: n for k, n in sizes.items() if n})


def split_counts(split_df: DataFrame) -> DataFrame:
    """Total, train and hold-out counts in one row."""
    return split_df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("holdout")).alias("train"),
        F.count_if(F.col("holdout")).alias("holdout"),
    )


def write_split(split_df: DataFrame, path: str) -> None:
    """Refuse to overwrite; one table partitioned by ``split``, each row as it came
    (an original line that the rows carry is kept as any other column).

    A task has one open file for each side, so whole rows are not sorted by side first."""
    with open_files(split_df.sparkSession, SIDES):
        split_df.write.mode("errorifexists").option("compression", "zstd").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A written split. A filter on ``split`` reads the files of that side only."""
    return spark.read.parquet(path)
