"""Token counts: an exact histogram of encoded lengths.

Each task encodes its texts and emits one row per distinct length; the rows are
added up map-side and over the table. Suffix sums over the histogram then answer,
for every context limit: how many documents are longer, how many tokens are left
when every document is cut at the limit, and which share of the documents fits.

The suffix sums run in two levels, over blocks of ``BLOCK`` lengths and inside
each block, so no task gets the whole histogram.

Null texts have length 0. An empty table gives an empty histogram.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import bound_batches, slices, texts_str

BLOCK = 512
#: Context limits and quantiles that the registered query answers.
LIMITS = (128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072)
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``n_tokens, n_docs``: documents by encoded length."""
    bound_batches(docs.sparkSession)

    def run(batches):
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        seen: Counter[int] = Counter()
        for batch in batches:
            for part in slices(batch, text_col):
                seen.update(len(encoder.encode_ordinary(t)) for t in texts_str(part, text_col))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                                             names=["n_tokens", "n_docs"])

    part = docs.select(text_col).mapInArrow(run, "n_tokens long, n_docs long")
    return part.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def answers(hist: DataFrame, limits: Sequence[int] = (), quantiles: Sequence[float] = ()) -> DataFrame:
    """One row per distinct length, and per wanted limit, ``context_limit``: ``n_docs`` of that
    length, ``n_longer``, ``tokens_total`` (of the whole table), ``tokens_kept`` when every
    document is cut at the limit, ``tokens_cut``, ``share_fitting``, and ``quantiles``, those of
    the wanted ones that this length answers (comma-joined; it is the smallest length that
    holds such a share of the documents). An empty table has no rows, whatever is wanted.

    The histogram is read twice: pass a written one."""
    if limits:
        wanted = hist.sparkSession.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
        hist = hist.unionByName(wanted).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    tokens = F.col("n_docs") * F.col("n_tokens")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    # one row per block of lengths: far fewer than lengths
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
                           F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                           F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    j = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "d_all", "t_all",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d_after")).alias("n_longer"),
        (F.coalesce(F.sum(tokens).over(inside), F.lit(0)) + F.col("t_after")).alias("t_longer"))
    cut = F.col("t_longer") - F.col("n_longer") * F.col("n_tokens")
    return j.where("d_all > 0").select(F.col("n_tokens").alias("context_limit"), "n_docs", "n_longer",
                    F.col("t_all").alias("tokens_total"), (F.col("t_all") - cut).alias("tokens_kept"),
                    cut.alias("tokens_cut"),
                    ((F.col("d_all") - F.col("n_longer")) / F.col("d_all")).alias("share_fitting"),
                    F.concat_ws(",", *[F.when((F.col("n_docs") > 0) & ((F.col("d_all") - F.col("n_longer")) / F.col("d_all") >= q)
                                              & ((F.col("d_all") - F.col("n_longer") - F.col("n_docs")) / F.col("d_all") < q), F.lit(f"{q:g}"))
                                       for q in quantiles]).alias("quantiles"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """One row: ``n_tokens``, the smallest length with at least ``q`` of the documents within it."""
    a = answers(hist)
    return a.where(F.col("share_fitting") >= F.lit(q)).agg(F.min("context_limit").alias("n_tokens"))
