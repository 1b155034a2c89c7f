"""Scenario scoring stream: what-if requests arrive as JSON files and are
validated, overlaid on the baseline and scored per micro-batch (R5–R10).

Each micro-batch is a static DataFrame, so the batch operators apply as they
are (``foreachBatch``); the fitted model, vocabulary and baseline are fixed for
the life of the query. Each batch writes its own folder ``batch=<id>`` of the
output, so a replayed batch replaces its rows; rejected requests are included
with their errors.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import features as FE
from ..operators import scenarios as SC
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from ..session import scratch_path

REQUEST_SCHEMA = "scenario_id string, numeric map<string,double>, categorical map<string,string>"


def start_scenario_stream(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    model,
    vocab_table: DataFrame,
    vocab: dict[str, list[str]],
    baseline: dict,
    lineage: dict,
    checkpoint_dir: str | None = None,
):
    requests = spark.readStream.schema(REQUEST_SCHEMA).json(source_dir)
    cats = [c for c in CATEGORICAL_FEATURES if c in baseline]
    vocab_table = vocab_table.cache()

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        v = SC.validate(batch, NUMERIC_FEATURES, vocab_table)
        o = SC.overlay(v, baseline, NUMERIC_FEATURES, cats)
        o = FE.apply_vocabulary(o, vocab, cats)
        SC.score_scenarios(o, model, lineage).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (
        requests.writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint_dir or scratch_path(spark, "scenario-stream-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
