"""The listing record and the fixed field lists derived from it.

The schema is fixed (not inferred per batch): a numeric column that happens
to be all-null stays numeric, booleans are categorical.
"""
from __future__ import annotations

from pyspark.sql import types as T

# The 20 listing fields in schema order, with their types.
LISTING_FIELDS: list[tuple[str, T.DataType]] = [
    ("price", T.DoubleType()),
    ("discount_amount", T.DoubleType()),
    ("currency", T.StringType()),
    ("brand", T.StringType()),
    ("model", T.StringType()),
    ("colour_1", T.StringType()),
    ("colour_2", T.StringType()),
    ("colour_3", T.StringType()),
    ("material_1", T.StringType()),
    ("material_2", T.StringType()),
    ("reclining", T.BooleanType()),
    ("pull_out_bed", T.BooleanType()),
    ("storage", T.BooleanType()),
    ("seat_number", T.LongType()),
    ("height", T.DoubleType()),
    ("width", T.DoubleType()),
    ("depth", T.DoubleType()),
    ("product_count", T.LongType()),
    ("additional_features", T.ArrayType(T.StringType())),
    ("evidence", T.ArrayType(T.StringType())),
]
LISTING_COLUMNS = [n for n, _ in LISTING_FIELDS]
LISTING_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in LISTING_FIELDS])

# Columns without price signal, dropped before modelling.
DROPPED_COLUMNS = ["evidence", "additional_features", "model", "discount_amount", "brand"]
LABEL = "price"

NUMBER_FIELDS = ["price", "discount_amount", "height", "width", "depth"]
INT_FIELDS = ["seat_number"]
BOOL_FIELDS = ["reclining", "pull_out_bed", "storage"]
TEXT_FIELDS = ["brand", "model", "colour_1", "colour_2", "colour_3", "material_1", "material_2", "currency"]
ARRAY_FIELDS = ["additional_features", "evidence"]

# Model features: 5 numeric, 9 categorical (booleans count as categorical).
NUMERIC_FEATURES = ["seat_number", "height", "width", "depth", "product_count"]
CATEGORICAL_FEATURES = [
    "currency", "colour_1", "colour_2", "colour_3", "material_1", "material_2",
    "reclining", "pull_out_bed", "storage",
]
FEATURES = [c for c in LISTING_COLUMNS if c in NUMERIC_FEATURES or c in CATEGORICAL_FEATURES]

# Extraction record written by the extraction stage (one JSON object per line).
RECORD_SCHEMA = T.StructType([
    T.StructField("image_path", T.StringType()),
    T.StructField("image_file", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("runtime_s", T.DoubleType()),
    T.StructField("attempts_used", T.IntegerType()),
    T.StructField("prompt_text", T.StringType()),
    T.StructField("raw_text", T.StringType()),
    T.StructField("parsed_json", LISTING_SCHEMA),
])

# Batch-inference input line: an extraction record or a bare listing, plus pass-through ids.
PASS_THROUGH = ["id", "image_file", "image_path", "url"]
INPUT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in PASS_THROUGH]
    + [T.StructField("parsed_json", LISTING_SCHEMA)]
    + [T.StructField(n, t) for n, t in LISTING_FIELDS]
)

LEDGER_STATUSES = ["ok", "failed", "blocked", "skipped", "timeout"]
DONE_STATUSES = ["ok", "skipped"]
