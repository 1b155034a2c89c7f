"""Ledger stream: crawl outcomes arrive as files; the latest-per-key table is
kept current by merging every micro-batch into it (L2 incrementally).

Latest-per-key is recomputed from (previous latest ∪ new outcomes), which is
exact because ``max_by`` is associative; no watermark is needed since no
state is kept by the stream itself. The latest table is written as a new
version per batch (batch id in the path); each batch starts from the newest
complete version below its own id, so a restarted query, or one that replays a
batch, goes on from what is written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ledger import latest
from ..session import scratch_path


def _version_path(base: str, batch_id: int) -> str:
    return f"{base}/v={batch_id:012d}"


def newest_version(spark: SparkSession, base: str, before: int | None = None) -> str | None:
    """Path of the newest completely written version (with an id below ``before``)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    ids = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    for i in sorted((i for i in ids if before is None or i < before), reverse=True):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{_version_path(base, i)}/_SUCCESS")):
            return _version_path(base, i)
    return None


def start_latest_stream(
    spark: SparkSession,
    source_dir: str,
    schema: StructType,
    table_dir: str,
    checkpoint_dir: str | None = None,
    key: str = "pos",
    max_files_per_trigger: int | None = None,
):
    """Start (availableNow) a stream from ``source_dir`` (parquet outcome files)
    keeping ``table_dir`` = latest outcome per key. Returns the query."""
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.load(source_dir)

    def merge(batch: DataFrame, batch_id: int) -> None:
        prev = newest_version(spark, table_dir, before=batch_id)
        current = batch if prev is None else spark.read.parquet(prev).unionByName(batch)
        latest(current, key).write.mode("overwrite").parquet(_version_path(table_dir, batch_id))

    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "ledger-stream-ckpt"))
        .trigger(availableNow=True)
        .start()
    )


def run_to_completion(spark: SparkSession, source_dir: str, schema: StructType, key: str = "pos",
                      max_files_per_trigger: int | None = 1) -> DataFrame:
    """Run the stream over everything in ``source_dir`` and return the latest table."""
    table_dir = scratch_path(spark, "ledger-latest")
    q = start_latest_stream(spark, source_dir, schema, table_dir, key=key,
                            max_files_per_trigger=max_files_per_trigger)
    q.awaitTermination()
    last = newest_version(spark, table_dir)
    return spark.createDataFrame([], schema) if last is None else spark.read.parquet(last)


def write_outcome_files(outcomes: DataFrame, path: str, files: int = 4) -> None:
    """Land outcomes as several files (the stream's input), grouped by key hash."""
    outcomes.repartition(files, F.col("pos")).write.mode("errorifexists").parquet(path)
