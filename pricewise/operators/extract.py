"""Raw model replies → typed, validated listing records.

Input is a table of replies ``(image_path, attempt, raw_text[, runtime_s, prompt_text])``
(the model call itself is outside this library). Every step is a column
expression over one row; only E17 groups, by image.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import (
    PY_WS, as_bool_of, as_int_of, is_blank_text, is_number_text, is_truthy_ts, number_text, py_strip,
)
from ..schema import ARRAY_FIELDS, BOOL_FIELDS, LISTING_COLUMNS, LISTING_SCHEMA, NUMBER_FIELDS, TEXT_FIELDS
from ..session import open_files, short_methods

# Fenced block (tagged json or untagged) and first-to-last brace.
FENCE_RE = "(?s)```(?:json)?[" + PY_WS + "]*(\\{.*?\\})[" + PY_WS + "]*```"
FIRST_OBJ_RE = "(?s)\\{.*\\}"
TRAILING_COMMA_RE = ",[" + PY_WS + "]*([}\\]])"
# Material separators and the seat pattern.
MATERIAL_SPLIT_RE = "[/,;+]| and "
SEATER_RE = "([0-9]+)[" + PY_WS + "]*seater"

ERR_NO_JSON = "the reply holds no JSON object"
ERR_BAD_JSON = "invalid JSON"
DEFAULT_RETRY = 1


# --------------------------------------------------------------------------- E1, E2
def json_text(raw: Column) -> Column:
    """The JSON object text inside a reply, or null.

    (a) the object in a code fence (tagged json or untagged), else (b) the whole
    text when it is braced, else (c) first '{' to last '}'. The fence regex only
    runs on replies that contain a fence; (c) is two index lookups."""
    t = py_strip(raw)
    return _object_text(t, _fenced(t))


def _fenced(t: Column) -> Column:
    return F.when(t.contains("```"), F.regexp_extract(t, FENCE_RE, 1))


def _object_text(t: Column, fenced: Column) -> Column:
    """E1 on a trimmed reply and its fenced object. What it finds starts with { and ends with }."""
    whole = F.when(t.startswith("{") & t.endswith("}"), t)
    i = F.instr(t, "{")
    j = F.length(t) - F.instr(F.reverse(t), "}") + 1
    first = F.when((i > 0) & (F.instr(t, "}") > 0) & (j > i), F.substring(t, i, j - i + 1))
    return F.coalesce(F.nullif(fenced, F.lit("")), whole, first)


def repair(text: Column) -> Column:
    """E2 (first half): delete commas that directly precede } or ]."""
    return _without_commas(py_strip(text))


def _without_commas(text: Column) -> Column:
    return F.regexp_replace(text, TRAILING_COMMA_RE, "$1")


def strict_parse(text: Column) -> Column:
    """E2 (second half): VARIANT of a single JSON object, null unless strictly valid.

    ``try_parse_json`` reads the first value and accepts trailing junk, so that value must
    also be all that an array and an object around the text hold. These two wrappings are
    only tokenized, no value is built from them.
    """
    v = F.try_parse_json(text)
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    closed = F.json_object_keys(F.concat(F.lit('{"k":'), text, F.lit("}"))).isNotNull()
    is_object = F.ltrim(text, F.lit(" \t\r\n")).startswith("{")
    return F.when(is_object & alone & closed, v)


# --------------------------------------------------------------------------- E3–E15
def _get(v: Column, path: str) -> Column:
    """One value of the parsed object, as VARIANT (no cast: casts out of VARIANT are slow)."""
    return F.try_variant_get(v, f"$.{path}", "variant")


def _strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _text_of(v: Column) -> Column:
    """Python str() of a JSON value (strings verbatim, others as JSON text)."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


def _items(text: Column) -> Column:
    """Texts of the items of a JSON array (strings verbatim, others as JSON text)."""
    return F.from_json(text, "array<string>")


def material_parts(t: Column, s: Column) -> Column:
    """E5: material text split on / , ; + or ' and ', or a list; trimmed, blanks removed.
    ``t`` and ``s`` are the value's type and text."""
    from_text = F.filter(F.transform(F.split(s, MATERIAL_SPLIT_RE), lambda x: py_strip(x)), lambda x: x != "")
    from_list = F.filter(F.transform(_items(s), lambda e: py_strip(F.coalesce(e, F.lit("null")))), lambda x: x != "")
    return (
        F.when(t == "STRING", from_text)
        .when(t.startswith("ARRAY"), from_list)
        .otherwise(F.array().cast("array<string>"))
    )


def seats_from_text(text: Column) -> Column:
    """The number before 'seater'."""
    return F.nullif(F.regexp_extract(F.lower(text), SEATER_RE, 1), F.lit("")).try_cast("bigint")


def currency_from_text(text: Column) -> Column:
    """First of £ → GBP, € → EUR, $ → USD."""
    return (
        F.when(text.contains("£"), F.lit("GBP"))
        .when(text.contains("€"), F.lit("EUR"))
        .when(text.contains("$"), F.lit("USD"))
    )


def string_array(t: Column, s: Column, v: Column) -> Column:
    """List kept; null / '' → []; any other scalar → [its text]. ``t`` may be null
    where the text does not start as a list."""
    return (
        F.when(t.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.transform(_items(s), lambda x: F.coalesce(x, F.lit("null"))))
        .when(t.startswith("ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), _text_of))
        .when(is_blank_text(s), F.array().cast("array<string>"))
        .otherwise(F.array(s))
    )


def non_string_items(t: Column) -> Column:
    """True when a list holds anything but strings; ``t`` names its item type."""
    return F.coalesce(t.startswith("ARRAY") & ~t.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))


_AUX_KEYS = ["name", "description", "delivery", "specifications"]
_SPEC_KEYS = ["materials", "material", "sofa_sizes", "size", "seater", "dimensions"]
_SIZE_KEYS = ["sofa_sizes", "size", "seater"]
_DIM_KEYS = ["width", "depth", "height"]


def normalize(df: DataFrame, v: str = "_v", text: str = "_rep") -> DataFrame:
    """E3–E15 as one column ``_f_<field>`` per listing field, plus ``_errors`` (E16) and
    ``_bad``, true where there are any.

    Texts come from one parse of the JSON object into a struct of strings (likewise for the
    nested specifications and dimensions), in which an absent value and JSON null are null.
    Types come from the VARIANT, but only where the text leaves a rule open: trimmed text is
    the same for all types, a text that is a number reads the same as a JSON number, and so on. The rules are staged as plain columns, so that an
    expression that several rules or branches use is computed once, and the cost is
    the sum over the fields that a query asks for."""
    V = F.col(v)
    df = df.withColumn("_j", F.from_json(F.when(V.isNotNull(), F.col(text)), _strings(LISTING_COLUMNS + _AUX_KEYS)))

    def t(n):
        return F.col(f"_t_{n}")

    def s(n):
        if n.startswith("spec_"):
            return F.col("_js")[n[5:]]
        return F.col("_jd")[n[4:]] if n.startswith("dim_") else F.col("_j")[n]

    def type_of(n):
        return F.schema_of_variant(_get(V, n))

    df = df.withColumns({
        "_t_specifications": F.when(s("specifications").startswith("{"), type_of("specifications")),
        "_t_name": F.when(is_blank_text(s("model")) & s("name").isNotNull(), type_of("name")),
        **{f"_t_{f}": F.when(s(f).startswith("["), type_of(f)) for f in ARRAY_FIELDS},
    })

    # nested objects
    spec_obj = F.coalesce(t("specifications").startswith("OBJECT"), F.lit(False))
    df = df.withColumns({
        "_vs": F.when(spec_obj, _get(V, "specifications")),
        "_js": F.from_json(F.when(spec_obj, s("specifications")), _strings(_SPEC_KEYS)),
    })
    S = F.col("_vs")
    stage = {f"_t_spec_{k}": F.schema_of_variant(_get(S, k)) for k in _SPEC_KEYS}
    for k in _SIZE_KEYS:
        stage[f"_t_first_{k}"] = F.schema_of_variant(_get(S, f"{k}[0]"))
    df = df.withColumns(stage)
    dims_obj = spec_obj & F.coalesce(t("spec_dimensions").startswith("OBJECT"), F.lit(False))
    df = df.withColumn("_jd", F.from_json(F.when(dims_obj, s("spec_dimensions")), _strings(_DIM_KEYS)))

    # values that fall back on another one: choose type and text first
    first_mats = is_truthy_ts(t("spec_materials"), s("spec_materials"))
    mats = spec_obj & is_blank_text(s("material_1")) & (
        first_mats | is_truthy_ts(t("spec_material"), s("spec_material")))
    choice = F.when(is_truthy_ts(t("spec_sofa_sizes"), s("spec_sofa_sizes")), 0).when(
        is_truthy_ts(t("spec_size"), s("spec_size")), 1).otherwise(2)
    stage = {
        "_use_mats": mats, "_first_mats": first_mats,
        "_size_of": F.when(spec_obj & s("seat_number").isNull(), choice),
    }
    for f in NUMBER_FIELDS:
        stage[f"_ns_{f}"] = F.when(dims_obj & s(f).isNull(), s(f"dim_{f}")).otherwise(s(f)) if f in _DIM_KEYS else s(f)
    df = df.withColumns(stage)

    size = F.col("_size_of")
    stage = {
        "_mt": F.when(F.col("_first_mats"), t("spec_materials")).otherwise(t("spec_material")),
        "_ms": F.when(F.col("_first_mats"), s("spec_materials")).otherwise(s("spec_material")),
        "_zt": F.when(size == 0, t("spec_sofa_sizes")).when(size == 1, t("spec_size")).when(size == 2, t("spec_seater")),
        "_zs": F.when(size == 0, s("spec_sofa_sizes")).when(size == 1, s("spec_size")).when(size == 2, s("spec_seater")),
        "_z0": F.when(size == 0, t("first_sofa_sizes")).when(size == 1, t("first_size")).when(size == 2, t("first_seater")),
    }
    for f in NUMBER_FIELDS:  # E9: number text without signs, separators and one unit
        stage[f"_n_{f}"] = F.when(is_number_text(F.col(f"_ns_{f}")), F.col(f"_ns_{f}")).otherwise(number_text(F.col(f"_ns_{f}")))
    for f in TEXT_FIELDS:
        stage[f"_x_{f}"] = py_strip(s(f))
    df = df.withColumns(stage)

    zt = F.col("_zt")
    stage = {
        "_parts": F.when(F.col("_use_mats"), material_parts(F.col("_mt"), F.col("_ms"))),
        "_seat": F.when(zt == "STRING", F.col("_zs")).when(zt.startswith("ARRAY") & (F.col("_z0") == "STRING"), F.get(_items(F.col("_zs")), 0)),
        "_count": as_int_of(s("product_count"), type_of("product_count")),
    }
    for f in NUMBER_FIELDS:
        stage[f"_d_{f}"] = F.when(is_number_text(F.col(f"_n_{f}")), F.col(f"_n_{f}").try_cast("double"))
    df = df.withColumns(stage)

    out: dict[str, Column] = {f: F.nullif(F.col(f"_x_{f}"), F.lit("")) for f in TEXT_FIELDS}     # E14
    # E8 currency, only when absent or JSON null; no sign stands in the text of a value that is false
    hint = F.concat(F.coalesce(s("description"), F.lit("")), F.lit(" "), F.coalesce(s("delivery"), F.lit("")))
    out["currency"] = F.when(s("currency").isNull(), currency_from_text(hint)).otherwise(out["currency"])
    # E4 model <- name (its type is known only where the model is blank)
    out["model"] = F.when(t("name") == "STRING", F.nullif(py_strip(s("name")), F.lit(""))).otherwise(out["model"])
    # E5 materials (the parts are trimmed and not blank)
    parts, use_mats = F.col("_parts"), F.col("_use_mats")
    out["material_1"] = F.when(use_mats, F.get(parts, 0)).otherwise(out["material_1"])
    out["material_2"] = F.when(use_mats & (F.size(parts) > 1), F.get(parts, 1)).otherwise(out["material_2"])
    for f in NUMBER_FIELDS:                                                                    # E6, E9
        d = F.col(f"_d_{f}")
        out[f] = F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)
    out["seat_number"] = F.when(F.col("_size_of").isNotNull(), seats_from_text(F.col("_seat"))) \
        .otherwise(as_int_of(s("seat_number"), type_of("seat_number")))                            # E7, E10
    out["product_count"] = F.when(F.col("_count") >= 1, F.col("_count")).otherwise(F.lit(1).cast("bigint"))  # E12
    for f in BOOL_FIELDS:
        out[f] = as_bool_of(s(f), type_of(f))                                                     # E11
    for f in ARRAY_FIELDS:
        out[f] = string_array(t(f), s(f), _get(V, f))                                          # E13
    errors = F.array_compact(F.array(*[F.when(non_string_items(t(f)), F.lit(f"{f}: items must be strings")) for f in ARRAY_FIELDS]))
    bad = F.lit(False)
    for f in ARRAY_FIELDS:
        bad = bad | non_string_items(t(f))
    fields = {f"_f_{c}": out[c].cast(LISTING_SCHEMA[c].dataType) for c in LISTING_COLUMNS}
    fields["_errors"], fields["_bad"] = errors, bad
    keep = [*df.columns, *fields]
    helpers = ("_t_", "_ns_", "_n_", "_x_", "_d_")
    single = {"_j", "_vs", "_js", "_jd", "_use_mats", "_first_mats", "_size_of", "_mt", "_ms", "_zt", "_zs", "_z0", "_parts", "_seat", "_count"}
    return df.withColumns(fields).select(*[c for c in keep if not c.startswith(helpers) and c not in single])


def clean_attempts(replies: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """E1–E16 for every reply row: adds json_text, v, n_allowed, n_other, errors, error,
    valid, one flat column ``f_<field>`` per listing field (null unless valid) and
    ``parsed``, the struct of them. A query that needs a few fields reads the flat
    columns: what it does not read is not computed."""
    # each stage is its own projected column, so the expensive text and JSON work
    # runs once per row (an inlined chain would be repeated inside every branch)
    short_methods(replies.sparkSession)
    df = (
        replies.withColumn("_reply", py_strip(F.col(text_col)))
        .withColumn("_fence", _fenced(F.col("_reply")))
        .withColumn("json_text", _object_text(F.col("_reply"), F.col("_fence")))
        .withColumn("_rep", _without_commas(F.col("json_text")))
        .withColumn("_v", strict_parse(F.col("_rep")))
        .drop("_reply", "_fence")
    )
    df = normalize(df, "_v", "_rep")
    keys = F.json_object_keys(F.when(F.col("_v").isNotNull(), F.col("_rep")))
    allowed = F.array(*[F.lit(c) for c in LISTING_COLUMNS])
    error = (
        F.when(F.col("json_text").isNull(), F.lit(ERR_NO_JSON))
        .when(F.col("_v").isNull(), F.lit(ERR_BAD_JSON))
        .when(F.col("_bad"), F.concat(F.lit("schema: "), F.array_join("_errors", "; ")))
    )
    df = df.withColumn("_keys", keys).withColumn("error", error).withColumn("valid", F.col("error").isNull())
    df = df.withColumns({
        # E3 census: how many keys were kept / dropped by the projection
        "n_allowed": F.when(F.col("_v").isNotNull(), F.size(F.array_intersect("_keys", allowed))),
        "n_other": F.when(F.col("_v").isNotNull(), F.size(F.array_except("_keys", allowed))),
        **{f"f_{c}": F.when(F.col("valid"), F.col(f"_f_{c}")) for c in LISTING_COLUMNS},
    })
    parsed = F.when(F.col("valid"), F.struct(*[F.col(f"f_{c}").alias(c) for c in LISTING_COLUMNS]))
    return (
        df.withColumn("parsed", parsed).withColumnRenamed("_errors", "errors").withColumnRenamed("_v", "v")
        .drop("_rep", "_keys", "_bad", *[f"_f_{c}" for c in LISTING_COLUMNS])
    )


# --------------------------------------------------------------------------- E17–E19
def first_valid(
    cleaned: DataFrame,
    key: str = "image_path",
    retry: int = DEFAULT_RETRY,
) -> DataFrame:
    """Per key, the first valid attempt among the first ``retry + 1``.

    Output: key, success, attempts_used, runtime_s (through the winning
    attempt), prompt_text, raw_text, parsed, last_error. One aggregate, after one shuffle by
    key: an aggregate of texts is a sorted one, and combining map-side would sort (and spill)
    all texts of a task for the few keys that it has twice. Only validity is worked out before
    it: the record is read from the winner's text after it, once for each key, and of its
    fields those that are asked for.
    """
    df = cleaned.where(F.col("attempt") <= retry + 1)
    if "runtime_s" not in df.columns:
        df = df.withColumn("runtime_s", F.lit(0.0))
    if "prompt_text" not in df.columns:
        df = df.withColumn("prompt_text", F.lit(""))
    tries = range(1, retry + 2)
    # only what is kept of a reply moves: its texts if it is valid, its error if not
    rows = df.select(key, "attempt", "runtime_s", "error", F.when(F.col("valid"), F.col("attempt")).alias("_by"),
                     F.when(F.col("valid"), F.struct("raw_text", "prompt_text")).alias("_reply"))
    done = rows.repartition(F.col(key)).groupBy(key).agg(
        F.min("_by").alias("_win"),
        F.min_by("_reply", "_by").alias("_w"),
        F.array(*[F.sum(F.when(F.col("attempt") <= a, F.col("runtime_s"))) for a in tries]).alias("_rt"),
        F.max_by("error", "attempt").alias("_last_error"),
        F.max("attempt").alias("attempts_tried"),
    )
    won = done.select(
        key,
        F.col("_win").isNotNull().alias("success"),
        F.coalesce(F.col("_win"), F.lit(0)).cast("int").alias("attempts_used"),
        F.get("_rt", F.greatest(F.coalesce("_win", F.lit(retry + 1)), F.lit(1)).cast("int") - 1).cast("double").alias("runtime_s"),
        F.col("_w.prompt_text").alias("prompt_text"),
        F.col("_w.raw_text").alias("raw_text"),
        F.when(F.col("_win").isNull(), F.col("_last_error")).alias("last_error"),
        "attempts_tried",
    )
    order = [key, "success", "attempts_used", "runtime_s", "prompt_text", "raw_text", "parsed", "last_error", "attempts_tried"]
    return clean_attempts(won).select(*order)


def route(outcomes: DataFrame, key: str = "image_path") -> DataFrame:
    """Extraction records. Failures keep the error; runtime 0, attempts 0,
    empty prompt, null raw text and null parsed record."""
    ok = F.col("success")
    return outcomes.select(
        F.col(key).alias("image_path"),
        F.regexp_extract(F.col(key), "[^/]*$", 0).alias("image_file"),
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("no valid JSON after "), F.col("attempts_tried").cast("string"),
                             F.lit(" attempt(s); last error: "), F.col("last_error"))).alias("error"),
        F.when(ok, F.col("runtime_s")).otherwise(F.lit(0.0)).alias("runtime_s"),
        F.when(ok, F.col("attempts_used")).otherwise(F.lit(0)).alias("attempts_used"),
        F.when(ok, F.col("prompt_text")).otherwise(F.lit("")).alias("prompt_text"),
        F.when(ok, F.col("raw_text")).alias("raw_text"),
        F.when(ok, F.col("parsed")).alias("parsed_json"),
    )


def extract_records(replies: DataFrame, key: str = "image_path", retry: int = DEFAULT_RETRY) -> DataFrame:
    """E1–E18 end to end."""
    return route(first_valid(clean_attempts(replies), key=key, retry=retry), key=key)


def successes(records: DataFrame) -> DataFrame:
    return records.where(F.col("success"))


def failures(records: DataFrame) -> DataFrame:
    return records.where(~F.col("success"))


def summary(records: DataFrame) -> DataFrame:
    """Total, ok, failed, success rate (0 when empty), summed runtime."""
    return records.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(F.col("success")).alias("successful_extractions"),
        F.count_if(~F.col("success")).alias("failed_extractions"),
        F.coalesce(F.try_divide(F.count_if(F.col("success")), F.count(F.lit(1))), F.lit(0.0)).cast("double").alias("success_rate"),
        F.coalesce(F.sum("runtime_s"), F.lit(0.0)).alias("runtime_s"),
    )


def write_records(records: DataFrame, path: str, overwrite: bool = False, runs: str | None = None, tags: dict | None = None) -> None:
    """One extraction table holding successes and failures, partitioned by
    ``success`` (so "successes only" / "failures only" are partition reads), packed with gzip.
    Refuses to replace an existing table unless ``overwrite``. With ``runs`` an extraction row
    is added to that table (S10), with the summary (E19) of the written records."""
    with open_files(records.sparkSession):
        records.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip").partitionBy("success").json(path)
    if runs is not None:
        from .train import append_run_log, run_log_rows
        spark = records.sparkSession
        m = summary(read_written_records(spark, path)).first().asDict()
        append_run_log(run_log_rows(spark, "extraction", {"output_path": path}, m, tags or {}), runs)


def read_written_records(spark, path: str) -> DataFrame:
    """Read an S8 table back with the declared record schema (``success`` typed as boolean)."""
    from ..schema import RECORD_SCHEMA
    return spark.read.schema(RECORD_SCHEMA).json(path)
