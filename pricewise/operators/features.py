"""Feature tables with fixed category vocabularies.

The schema is fixed: numeric and categorical lists are constants from
``schema.py``; a value outside the vocabulary becomes missing.
"""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import global_row_number
from ..schema import CATEGORICAL_FEATURES, DROPPED_COLUMNS, LABEL

DEFAULT_PRICE_CAP = 6000.0
#: Levels of a vocabulary that may be broadcast; copies of a larger one; levels that the driver may hold.
MAX_BROADCAST_LEVELS, SALTS, MAX_DRIVER_LEVELS = 200_000, 32, 1_000_000


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """nested structs become dotted top-level columns; arrays stay cells."""
    def walk(schema: T.StructType, prefix: list[str]):
        for f in schema.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))
    return df.select(*walk(df.schema, []))


def drop_unused(df: DataFrame, keep_price: bool = False) -> DataFrame:
    """drop the five signal-free columns (if present), and price unless kept."""
    return df.drop(*(DROPPED_COLUMNS + ([] if keep_price else [LABEL])))


def column_kinds(df: DataFrame) -> DataFrame:
    """one row per column, 'numeric' for numbers, 'categorical' for the rest
    (booleans included)."""
    rows = [(f.name, "numeric" if isinstance(f.dataType, T.NumericType) else "categorical", i)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, position int")


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)
            and not isinstance(f.dataType, T.ArrayType)]


def _as_level(c: str) -> F.Column:
    return F.col(c).cast("string")


def vocabulary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """sorted distinct non-null levels per categorical column.

    One unpivot + one distinct aggregate for all columns (partial aggregation collapses hot
    values before the shuffle). The levels of all columns are ranked together by range
    partitions (``global_row_number``), so no task sorts a whole column. Output ``(column,
    position, value, value_type)`` with 0-based position in sorted order."""
    cols = list(columns) if columns is not None else [c for c in CATEGORICAL_FEATURES if c in df.columns]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_level(c).alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    ranked = global_row_number(long.distinct(), ["column", "value"], out="_g")
    first = ranked.groupBy("column").agg(F.min("_g").alias("_first"))  # a row for each column
    vt = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    return (ranked.join(F.broadcast(first), "column").withColumn("position", (F.col("_g") - F.col("_first")).cast("int"))
            .withColumn("value_type", vt[F.col("column")]).select("column", "position", "value", "value_type"))


def vocabulary_dict(vocab: DataFrame) -> dict[str, list[str]]:
    """Driver-side copy of a vocabulary of at most ``MAX_DRIVER_LEVELS`` levels."""
    rows = vocab.select("column", "position", "value").limit(MAX_DRIVER_LEVELS + 1).collect()
    if len(rows) > MAX_DRIVER_LEVELS:
        raise ValueError(f"a vocabulary beyond {MAX_DRIVER_LEVELS} levels stays a table")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["column"], r["position"])):
        out.setdefault(r["column"], []).append(r["value"])
    return out


def vocabulary_table(spark: SparkSession, vocab: dict[str, list[str]]) -> DataFrame:
    """A vocabulary as rows ``(column, position, value)``."""
    return spark.createDataFrame([(c, i, v) for c, vals in vocab.items() for i, v in enumerate(vals)], "column string, position int, value string")


def known_levels(df: DataFrame, vocab: DataFrame, columns: Sequence[str], key: str | None = None, most: int = MAX_BROADCAST_LEVELS) -> DataFrame:
    """``df`` with ``_pos_<column>``: the position of each value in the vocabulary (null outside it).

    The vocabulary is counted first. Up to ``most`` levels go to the rows (a broadcast join
    per column, all in one stage). A larger one meets the rows in one join on (column, value):
    levels are repeated ``SALTS`` times, so that the rows of a hot level are spread, and the
    positions of a row come back by its ``key``."""
    levels = vocab.where(F.col("column").isin(list(columns))).select("column", "value", "position")
    if levels.count() <= most:
        for c in columns:
            own = levels.where(F.col("column") == c).select(F.col("value").alias("_level"), F.col("position").alias(f"_pos_{c}"))
            df = df.join(F.broadcast(own), _as_level(c) == F.col("_level"), "left").drop("_level")
        return df
    if key is None:
        raise ValueError("a vocabulary beyond the broadcast bound needs the key of the rows")
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    long = df.select(key, salt.alias("_salt"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), _as_level(c).alias("value")) for c in columns])).alias("kv")).select(key, "_salt", "kv.*")
    salted = levels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = long.join(salted, ["column", "value", "_salt"]).groupBy(key).agg(*[
        F.max(F.when(F.col("column") == c, F.col("position"))).alias(f"_pos_{c}") for c in columns])
    return df.join(found, key, "left")


def apply_vocabulary(df: DataFrame, vocab: DataFrame | dict[str, list[str]], columns: Iterable[str] | None = None, key: str | None = None) -> DataFrame:
    """categorical columns as level text; values outside the vocabulary become null. A
    column that the vocabulary does not name keeps its own levels (F5).

    A vocabulary on the driver becomes a table; see ``known_levels`` for how rows meet it."""
    cols = list(columns) if columns is not None else [c for c in CATEGORICAL_FEATURES if c in df.columns]
    named = {r["column"] for r in vocab.select("column").distinct().collect()} if isinstance(vocab, DataFrame) else set(vocab)
    table = vocab if isinstance(vocab, DataFrame) else vocabulary_table(df.sparkSession, vocab)
    known = [c for c in cols if c in named]
    order = df.columns
    out = known_levels(df, table, known, key) if known else df
    return out.select(*[F.when(F.col(f"_pos_{c}").isNotNull(), _as_level(c)).alias(c) if c in known else (_as_level(c).alias(c) if c in cols else F.col(f"`{c}`"))
                        for c in order])


def inferred_categories(df: DataFrame, columns: Iterable[str] | None = None, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """categorical columns by their own levels: (``df`` with the level text and
    ``<column>_code``, the position of the level, -1 where it is missing; the vocabulary)."""
    cols = list(columns) if columns is not None else [c for c in CATEGORICAL_FEATURES if c in df.columns]
    vocab = vocabulary(df, cols)
    coded = known_levels(df, vocab, cols, key)
    return coded.select(*[_as_level(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns],
                        *[F.coalesce(F.col(f"_pos_{c}"), F.lit(-1)).alias(f"{c}_code") for c in cols]), vocab


def price_cap(df: DataFrame, cap: float = DEFAULT_PRICE_CAP, label: str = LABEL) -> DataFrame:
    """keep rows with price strictly below the cap; missing price drops out."""
    return df.where(F.col(label) < F.lit(cap))


def align(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """error on missing model columns, drop extras, reorder."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {len(missing)} column(s) that the model reads: {missing}")
    return df.select(*names)
