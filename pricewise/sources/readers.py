"""Readers.

All readers take a declared schema (no inference pass over the data) and
keep physical positions only where the contract needs them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..schema import INPUT_SCHEMA, LISTING_COLUMNS, LISTING_SCHEMA, RECORD_SCHEMA

#: File splits whose line counts may be broadcast.
MAX_SPLITS = 1_000_000


def _object_text(text: Column, what: Column) -> Column:
    """The text where it is a JSON object; anything else stops the job."""
    v = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, text).otherwise(
        F.raise_error(F.concat(what, F.lit(" holds no JSON object: "), F.substring(text, 1, 80))))


# --------------------------------------------------------------------------- S1
def parse_record_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """S1 core: JSON lines → parsed listing records.

    Blank lines and records whose ``parsed_json`` is null or missing are
    skipped; a line that is no JSON object fails the job. A field whose value has
    another type than the schema's is null. Works on any text column (files via
    ``read_records``)."""
    text = lines.where(F.trim(F.col(col)) != "").select(F.col(col).alias("_text"))
    parsed = text.select(F.from_json(_object_text(F.col("_text"), F.lit("record line")), RECORD_SCHEMA).alias("r"))
    return parsed.where(F.col("r.parsed_json").isNotNull()).select("r.parsed_json.*")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Extraction-record JSONL file(s) → the ``parsed_json`` listings."""
    return parse_record_lines(spark.read.text(path))


def record_lines_from_listings(
    lst: DataFrame,
    key: str,
    fail_when: Column | None = None,
    blank_when: Column | None = None,
) -> DataFrame:
    """Extraction-record JSON lines built from a listing table (test input for S1).

    Rows matching ``fail_when`` become failed records (null parsed_json); rows
    matching ``blank_when`` contribute an extra blank line."""
    fail = fail_when if fail_when is not None else F.lit(False)
    parsed = F.struct(*[
        (F.col(c) if c in lst.columns else F.array().cast("array<string>")).cast(LISTING_SCHEMA[c].dataType).alias(c)
        for c in LISTING_COLUMNS
    ])
    rec = F.struct(
        F.concat(F.lit("shots/"), F.col(key), F.lit(".png")).alias("image_path"),
        F.concat(F.col(key), F.lit(".png")).alias("image_file"),
        (~fail).alias("success"),
        F.when(fail, F.lit("extraction failed")).alias("error"),
        F.lit(1.0).alias("runtime_s"),
        F.when(fail, 0).otherwise(1).alias("attempts_used"),
        F.lit("").alias("prompt_text"),
        F.lit(None).cast("string").alias("raw_text"),
        F.when(~fail, parsed).alias("parsed_json"),
    )
    lines = lst.select(F.to_json(rec).alias("value"))
    if blank_when is not None:
        lines = lines.unionByName(lst.where(blank_when).select(F.lit("   ").alias("value")))
    return lines


# --------------------------------------------------------------------------- S2
def read_inference_input(spark: SparkSession, path: str) -> DataFrame:
    """S2 + P4 index: JSONL (``input_index`` = physical line number, blanks
    counted) or a ``.json`` document holding an array or ``{"records": [...]}``.

    An entry that is no JSON object fails the job; a field whose value has another
    type than the schema's counts as missing. Output: ``input_index``,
    ``record_index`` (blank lines not counted), ``entry`` (INPUT_SCHEMA struct)."""
    if path.lower().endswith(".json"):
        doc = spark.read.option("multiLine", True).text(path, wholetext=True)
        v = F.parse_json(F.col("value"))
        t = F.schema_of_variant(v)
        recs = F.try_variant_get(v, "$.records", "array<variant>")
        items = (
            F.when(t.startswith("ARRAY"), F.variant_get(v, "$", "array<variant>"))
            .when(t.startswith("OBJECT") & recs.isNotNull(), recs)
            .otherwise(F.raise_error(F.lit("a JSON document for scoring is an array, or an object with an array under 'records'")))
        )
        exploded = doc.select(F.posexplode(items).alias("input_index", "item"))
        return exploded.select(
            F.col("input_index").cast("long"),
            F.col("input_index").cast("long").alias("record_index"),
            F.from_json(_object_text(F.to_json(F.col("item")), F.format_string("entry %d", "input_index")), INPUT_SCHEMA).alias("entry"),
        )
    lines = indexed_lines(spark, path)
    return lines.select(
        "input_index", "record_index",
        F.from_json(_object_text(F.col("value"), F.format_string("line %d", "input_index")), INPUT_SCHEMA).alias("entry"))


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The text lines that are not blank, with their 0-based physical line number
    across all files (files in path order; ``input_index``) and the number of such
    lines before them (``record_index``).

    Ids that rise within a task number the lines of a file split from its first one;
    the counts of earlier splits go to the lines (one row per split, at most
    ``MAX_SPLITS`` of them), so no line is sorted or moved for its number."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )
    # ids are handed out again behind the filter: there they count the lines that are left
    full = raw.where(F.trim("value") != "").withColumn("_r", F.monotonically_increasing_id())
    lines = raw.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    records = full.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_k"), F.min("_r").alias("_r0"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.join(records, ["_f", "_b"], "left").select(
        "_f", "_b", "_m0", "_r0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_k").over(w), F.lit(0)).alias("_koff"))
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() > MAX_SPLITS:  # no more splits than that
        raise ValueError(f"more than {MAX_SPLITS} file splits: raise spark.sql.files.maxPartitionBytes")
    return full.join(F.broadcast(splits), ["_f", "_b"]).select(
        (F.col("_off") + F.col("_m") - F.col("_m0")).alias("input_index"),
        (F.col("_koff") + F.col("_r") - F.col("_r0")).alias("record_index"), "value")


# --------------------------------------------------------------------------- S3
def worklist(urls: DataFrame, order_col: str | None = None, limit: int = 1000, url_col: str = "url") -> DataFrame:
    """S3: 1-based position per url (in ``order_col`` order), first ``limit`` (0: all).

    With a limit only those rows are ordered (each task keeps its first ``limit``)
    and numbered; without one the numbering is distributed."""
    order = [order_col] if order_col else [url_col]
    rows = urls.select(*dict.fromkeys([*order, url_col]))
    if limit and limit > 0:
        first = rows.orderBy(*order).limit(limit)
        ranked = first.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = global_row_number(rows, order, out="pos")
    return ranked.select(F.col("pos").cast("long"), F.col(url_col).alias("url"))


def read_worklist(spark: SparkSession, csv_path: str, limit: int = 1000) -> DataFrame:
    """S3 from a CSV with a ``url`` column; position = line order in the file."""
    df = spark.read.option("header", True).schema("url string").csv(csv_path)
    df = df.withColumn("_f", F.col("_metadata.file_path")).withColumn(
        "_b", F.col("_metadata.file_block_start")).withColumn("_m", F.monotonically_increasing_id())
    ranked = global_row_number(df, ["_f", "_b", "_m"], out="pos")
    out = ranked.select(F.col("pos").cast("long"), "url")
    return out.where(F.col("pos") <= limit) if limit and limit > 0 else out


# --------------------------------------------------------------------------- S4
def list_images(spark: SparkSession, directory: str, glob: str = "*.png", limit: int = 0) -> DataFrame:
    """Image files matching a glob, sorted by path, first N if N > 0.

    The pattern may name folders (``sub/*.png``); ``**`` looks into all folders
    below. Reads only file metadata (path, size, mtime), never the bytes. A missing
    directory or no match is an error."""
    folder, _, name = glob.rpartition("/")
    reader = spark.read.format("binaryFile").option("pathGlobFilter", name)
    parts = [p for p in folder.split("/") if p]
    if "**" in parts:
        reader = reader.option("recursiveFileLookup", True)
        parts = parts[:parts.index("**")]
    df = reader.load("/".join([directory.rstrip("/"), *parts])).select("path", "length", "modificationTime")
    df = df.orderBy("path")
    if limit > 0:
        df = df.limit(limit)
    if df.isEmpty():
        raise FileNotFoundError(f"{directory}: nothing matches {glob}")
    return df
