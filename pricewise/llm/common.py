"""Helpers shared by the operators: table reading, bounded Arrow batches."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from pricewise.session import scratch_path

#: Bytes of Arrow data that Spark hands to a Python worker at once.
ARROW_BATCH_BYTES = 16 << 20
#: Bytes of text that the numpy kernels work on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES):
    """Consecutive row slices of ``batch`` with at most ``budget`` bytes in
    ``column`` (a longer text stands alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lo, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if i > lo and total + s > budget:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += s
    if lo < len(size):
        yield batch.slice(lo, len(size) - lo)


def texts_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


def texts_str(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Each text as str; null as empty. Bytes that are no UTF-8 become U+FFFD."""
    try:
        return [s or "" for s in batch.column(column).to_pylist()]
    except UnicodeDecodeError:
        return [b.decode("utf-8", "replace") for b in texts_bytes(batch, column)]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: the
    lineage ends there, and a lost executor cannot change what was counted."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def check_broadcast(n: int, most: int, what: str) -> None:
    """Refuse to hand out a table beyond its stated bound."""
    if n > most:
        raise ValueError(f"{what}: {n} entries, but at most {most} may be broadcast")
