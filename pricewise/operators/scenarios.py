"""Baseline, options and scenario scoring as table jobs.

The serving endpoints of the reference become batch operators: a table of
scenario requests in, a table of prices (or errors) out.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import exact_quantiles_multi
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

DEFAULT_TOP_K = 10
#: Levels of a vocabulary that may be broadcast, and copies of a larger one.
MAX_BROADCAST_LEVELS = 200_000
SALTS = 32


# --------------------------------------------------------------------------- R1
def numeric_defaults(train: DataFrame, columns: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """Median of positive values; else median of all; else 1.0 (no price cap).

    Medians are exact (``exact_quantiles_multi``, all columns at once)."""
    cols = [c for c in columns if c in train.columns]
    exprs = {}
    for c in cols:
        x = F.col(c).cast("double")
        exprs[f"{c}|pos"] = F.when(x > 0, x)
        exprs[f"{c}|all"] = x
    med = exact_quantiles_multi(train, exprs, [0.5])
    rows = []
    for i, c in enumerate(cols):
        pos, allv = med[f"{c}|pos"], med[f"{c}|all"]
        val = pos[0] if pos else (allv[0] if allv else 1.0)
        rows.append((c, i, float(val)))
    return train.sparkSession.createDataFrame(rows, "field string, position int, default double")


# --------------------------------------------------------------------------- R3 / R2
def level_counts(train: DataFrame, vocab: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Vocabulary levels with their frequency in ``train`` (0 when unseen).

    One unpivot + partial aggregation; a hot level collapses map-side."""
    cols = list(columns) if columns is not None else [c for c in CATEGORICAL_FEATURES if c in train.columns]
    long = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        vocab.where(F.col("column").isin(cols)).select("column", "position", "value")
        .join(counts, ["column", "value"], "left").fillna(0, subset=["n"])
    )


def top_values(counts: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Top-K allowed values per column by count, ties and unseen allowed values (the
    back-fill) in vocabulary order, up to min(K, size). K ≤ 0 → empty.

    Each of ``SALTS`` parts of a column keeps its own first K, so the last ranking reads at
    most ``SALTS`` × K rows of a column, however many levels it has."""
    if k <= 0:
        return counts.limit(0).select("column", F.lit(0).alias("rank"), "value", "n")
    order = [F.col("n").desc(), F.col("position")]
    part = Window.partitionBy("column", "_part").orderBy(*order)
    first = (counts.withColumn("_part", F.pmod("position", F.lit(SALTS))).withColumn("_rank", F.row_number().over(part))
             .where(F.col("_rank") <= k))
    whole = Window.partitionBy("column").orderBy(*order)
    return first.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def categorical_defaults(counts: DataFrame) -> DataFrame:
    """R2: most frequent level (ties: first in level order); else the first level. One
    aggregate that combines before the shuffle."""
    best = F.max(F.struct("n", (-F.col("position")).alias("p"), "value"))
    return counts.groupBy("column").agg(best.alias("x")).select("column", F.col("x.value").alias("value"))


# --------------------------------------------------------------------------- R4
def schema_table(numeric: DataFrame, vocab: DataFrame, top: DataFrame, defaults: DataFrame,
                 lineage: dict | None = None, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """The serving schema as one long table ``(section, field, position, value)``.

    Sections: numeric_default, numeric_above (the exclusive lower bound 0), allowed
    (non-empty vocabularies only), top, top_k (the K of ``top``), categorical_default,
    lineage (model version, training run, split)."""
    num = numeric.select(F.lit("numeric_default").alias("section"), "field", "position",
                         F.format_string("%.6f", "default").alias("value"))
    above = numeric.select(F.lit("numeric_above").alias("section"), "field", "position", F.lit("0").alias("value"))
    allowed = vocab.select(F.lit("allowed").alias("section"), F.col("column").alias("field"), "position", "value")
    tops = top.select(F.lit("top").alias("section"), F.col("column").alias("field"),
                      (F.col("rank") - 1).alias("position"), "value")
    dflt = defaults.select(F.lit("categorical_default").alias("section"), F.col("column").alias("field"),
                           F.lit(0).alias("position"), "value")
    names = ["model_version", "train_run_id", "data_split_id"]
    rest = [("top_k", "", 0, str(top_k))] + [("lineage", n, i, (lineage or {}).get(n)) for i, n in enumerate(names)]
    fixed = numeric.sparkSession.createDataFrame(rest, "section string, field string, position int, value string")
    return num.unionByName(above).unionByName(allowed).unionByName(tops).unionByName(dflt).unionByName(fixed)


# --------------------------------------------------------------------------- R5–R10
# Text accepted for boolean-valued fields.
TRUE_TEXT = ["true", "1", "yes"]
FALSE_TEXT = ["false", "0", "no"]


def baseline_row(numeric: DataFrame, defaults: DataFrame) -> dict:
    """Baseline feature values (R1 + R2): one small dict on the driver,
    bounded by the number of features."""
    base = {r["field"]: r["default"] for r in numeric.collect()}
    base.update({r["column"]: r["value"] for r in defaults.collect()})
    return base


def explode_overrides(scenarios: DataFrame, id_col: str = "scenario_id") -> DataFrame:
    """Categorical overrides as rows ``(scenario_id, field, value)``."""
    return scenarios.select(id_col, F.explode("categorical").alias("field", "value"))


def _with_levels(rows: DataFrame, levels: DataFrame, on: list[str], n_levels: int, salt_by: str) -> DataFrame:
    """Left join with the vocabulary levels. A few (field, value) pairs hold most rows:
    a vocabulary within ``MAX_BROADCAST_LEVELS`` goes to the rows, a larger one is
    repeated ``SALTS`` times and the rows of a pair are spread over the copies."""
    if n_levels <= MAX_BROADCAST_LEVELS:
        return rows.join(F.broadcast(levels), on, "left")
    salted = levels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
            .join(salted, [*on, "_salt"], "left").drop("_salt"))


def coerce_values(overrides: DataFrame, vocab: DataFrame, id_col: str = "scenario_id") -> DataFrame:
    """R7 + R8: exact match first; boolean fields also take true/1/yes and
    false/0/no (trimmed, any case); fields whose levels are all numbers take a
    number in any notation; then membership in the allowed values.
    Adds ``coerced`` and ``allowed``."""
    from ..functions.coerce import py_strip
    number = F.col("value").try_cast("double")
    kinds = vocab.groupBy(F.col("column").alias("field")).agg(
        F.max(F.col("value_type") == "boolean").alias("is_bool"), F.bool_and(number.isNotNull()).alias("is_number"))
    n = vocab.count()
    levels = vocab.select(F.col("column").alias("field"), "value", F.lit(True).alias("_hit"))
    by_number = levels.groupBy("field", number.alias("_number")).agg(F.min("value").alias("_level")).where("_number IS NOT NULL")
    x = overrides.join(F.broadcast(kinds), "field", "left")  # one row per field
    x = _with_levels(x, levels, ["field", "value"], n, id_col)
    text = py_strip(F.col("value"))
    x = _with_levels(x.withColumn("_number", F.when(F.col("is_number"), text.try_cast("double"))), by_number, ["field", "_number"], n, id_col)
    w = F.lower(text)
    coerced = (
        F.when(F.col("_hit"), F.col("value"))
        .when(F.col("is_bool") & w.isin(*TRUE_TEXT), F.lit("true"))
        .when(F.col("is_bool") & w.isin(*FALSE_TEXT), F.lit("false"))
        .otherwise(F.coalesce("_level", "value"))
    )
    c = x.withColumn("coerced", coerced).drop("_hit", "is_bool", "is_number", "_number", "_level")
    checked = _with_levels(c, levels.withColumnRenamed("value", "coerced"), ["field", "coerced"], n, id_col)
    return checked.withColumn("allowed", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def single_overrides(requests: DataFrame, id_col: str = "scenario_id") -> DataFrame:
    """R10, the short request form (``numeric_field, numeric_value, categorical_field,
    categorical_value``, any of them null) as the maps that ``validate`` takes."""
    def one(field: str, value: str, kind: str):
        return F.when(F.col(field).isNotNull() & F.col(value).isNotNull(),
                      F.create_map(F.col(field), F.col(value).cast(kind))).otherwise(
            F.create_map().cast(f"map<string,{kind}>"))
    return requests.select(id_col, one("numeric_field", "numeric_value", "double").alias("numeric"),
                           one("categorical_field", "categorical_value", "string").alias("categorical"))


def validate(scenarios: DataFrame, numeric_fields: list[str], vocab: DataFrame, id_col: str = "scenario_id") -> DataFrame:
    """R5–R8 per scenario: ``errors`` (array, empty when valid) and the
    coerced categorical map. Rejected scenarios stay in the table."""
    cat_fields = [r["column"] for r in vocab.select("column").distinct().collect()]  # bounded by #features
    num_keys = F.map_keys(F.col("numeric"))
    nonpos = F.map_keys(F.map_filter("numeric", lambda k, v: (v <= 0) | F.isnan(v) | v.isNull()))
    unknown_num = F.array_except(num_keys, F.array(*[F.lit(f) for f in numeric_fields]))
    unknown_cat = F.array_except(F.map_keys(F.col("categorical")), F.array(*[F.lit(f) for f in cat_fields]))
    base = scenarios.select(
        id_col, "numeric", "categorical",
        F.array_sort(nonpos).alias("nonpositive"),
        F.array_sort(unknown_num).alias("unknown_numeric"),
        F.array_sort(unknown_cat).alias("unknown_categorical"),
    )
    ov = coerce_values(explode_overrides(scenarios, id_col), vocab, id_col)
    known = ov.where(F.col("field").isin(cat_fields))
    per = known.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "coerced"))).alias("coerced"),
        F.array_sort(F.collect_list(F.when(~F.col("allowed"), F.col("field")))).alias("not_allowed"),
    )
    out = base.join(per, id_col, "left")
    msg = lambda arr, fmt: F.transform(F.coalesce(arr, F.array().cast("array<string>")), lambda f: F.format_string(fmt, f))
    errors = F.concat(
        msg(F.col("unknown_numeric"), "no number can be set for %s"),
        msg(F.col("nonpositive"), "%s takes numbers above zero"),
        msg(F.col("unknown_categorical"), "no level can be set for %s"),
        msg(F.col("not_allowed"), "%s has no such level"),
    )
    return out.withColumn("errors", errors).withColumn(
        "coerced", F.coalesce(F.col("coerced"), F.create_map().cast("map<string,string>")))


def overlay(validated: DataFrame, baseline: dict, numeric_fields: list[str], categorical_fields: list[str],
            id_col: str = "scenario_id") -> DataFrame:
    """Baseline row with the overrides applied (numeric map, coerced categorical map)."""
    cols = [F.coalesce(F.col("numeric")[f], F.lit(baseline.get(f)).cast("double")).alias(f) for f in numeric_fields]
    cols += [F.coalesce(F.col("coerced")[f], F.lit(baseline.get(f)).cast("string")).alias(f) for f in categorical_fields]
    return validated.select(id_col, "errors", *cols)


def score_scenarios(overlaid: DataFrame, model, lineage: dict, id_col: str = "scenario_id") -> DataFrame:
    """Price for valid scenarios (with model version, run id, split id);
    rejected rows keep their errors and a null price."""
    scored = model.transform(overlaid)
    ok = F.size("errors") == 0
    return scored.select(
        id_col,
        F.when(ok, F.col("prediction")).alias("predicted_price"),
        F.lit(lineage.get("model_version")).cast("string").alias("model_version"),
        F.lit(lineage.get("train_run_id")).cast("string").alias("train_run_id"),
        F.lit(lineage.get("data_split_id")).cast("string").alias("data_split_id"),
        "errors",
    )
