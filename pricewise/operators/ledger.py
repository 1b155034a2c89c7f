"""The data side of the page collector, as an append-only outcome table.

The reference keeps a map position → last outcome plus counters in one JSON
file. Here outcomes are rows ``(pos, ts, event_id, status, …)``; "latest per
key" and the counters are aggregates over that table, so a restart simply
re-reads it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import py_strip
from ..schema import DONE_STATUSES, LEDGER_STATUSES

# Phrases that, together with "cloudflare", mark a bot-check page.
BLOCK_SIGNALS = [
    "verify you are human",
    "checking your browser",
    "security verification",
    "ray id",
    "cf-challenge",
    "challenge-platform",
]
PREVIEW_CHARS = 180


def latest(outcomes: DataFrame, key: str = "pos", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """L2: one last outcome per key; later overwrites earlier (ties by event id).

    ``max_by`` over a struct aggregates partially per task, so a key retried
    millions of times still shuffles one row per task."""
    cols = [c for c in outcomes.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order])
    return outcomes.groupBy(key).agg(F.max_by(F.struct(*cols), ordering).alias("_last")).select(key, "_last.*")


def pending(worklist: DataFrame, outcomes: DataFrame, key: str = "pos") -> DataFrame:
    """L1: worklist minus keys whose latest status is ok or skipped."""
    done = latest(outcomes.select(key, "ts", "event_id", "status"), key).where(F.col("status").isin(*DONE_STATUSES))
    return worklist.join(done.select(key), key, "left_anti")


def status_counts(outcomes: DataFrame, key: str = "pos") -> DataFrame:
    """L3: counters over events (a retried key counts each time; unknown
    statuses count as failed) plus ``done`` over the latest status per key.
    Output ``(metric, n)``; all five statuses are present, zero if unseen."""
    bucket = F.when(F.col("status").isin(*LEDGER_STATUSES), F.col("status")).otherwise(F.lit("failed"))
    ev = outcomes.groupBy(bucket.alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    spark = outcomes.sparkSession
    names = spark.createDataFrame([(s,) for s in LEDGER_STATUSES], "metric string")
    events = names.join(ev, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("n"))
    done = latest(outcomes.select(key, "ts", "event_id", "status"), key).agg(
        F.count_if(F.col("status").isin(*DONE_STATUSES)).alias("n")).select(F.lit("done").alias("metric"), "n")
    return events.unionByName(done)


def is_blocked_page(html: Column) -> Column:
    """L4: contains 'cloudflare' and one further signal phrase, any case."""
    h = F.lower(html)
    return h.contains("cloudflare") & F.greatest(*[h.contains(s) for s in BLOCK_SIGNALS])


def classify_outcome(
    timed_out: Column,
    failed: Column,
    screenshot_saved: Column,
    blocked: Column,
    http_status: Column,
    size_bytes: Column,
    duration_s: Column,
) -> dict[str, Column]:
    """Status, HTTP class, size in KB (1 place) and duration (2 places).

    Rounding is half-even on the decimal value, like Python's ``round`` on
    the values this sees (durations to the centisecond, sizes in 1/1024 KB)."""
    status = (
        F.when(timed_out, F.lit("timeout"))
        .when(failed | ~screenshot_saved, F.lit("failed"))
        .when(blocked, F.lit("blocked"))
        .otherwise(F.lit("ok"))
    )
    http_class = (
        F.when(http_status >= 500, F.lit("server_error"))
        .when(http_status >= 400, F.lit("client_error"))
        .when(http_status.isNotNull(), F.lit("ok"))
    )
    ok_shot = screenshot_saved & ~timed_out & ~failed
    return {
        "status": status,
        "http_class": http_class,
        "screenshot_kb": F.when(ok_shot, F.bround(size_bytes / 1024.0, 1)),
        "duration_s": F.bround(duration_s, 2),
        "cloudflare_blocked": F.when(timed_out, F.lit(False)).otherwise(blocked),
    }


def artefact_name(pos: Column) -> Column:
    """Screenshot file name, position zero-padded to at least 2 digits."""
    return F.format_string("screenshot_%02d.png", pos)


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    """Newlines → spaces, trimmed, cut to n characters with '...' when longer."""
    s = py_strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))
