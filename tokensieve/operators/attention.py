"""Attention that patches receive, from queries and keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.functions.checks import required

FRAME = ("video_id", "frame")
#: Ids of a run, the unit of prefix sums.
RUN = 1 << 14


def received_attention(qk: DataFrame, query_chunk: int = 128) -> DataFrame:
    """(video_id, frame, patch, attention) of qk(video_id, frame, head, patch, q, k).

    Within a frame and head every query spreads a weight of one over the keys, by the softmax of the scaled products;
    a patch receives the mean over heads and queries. One head's matrix is built at a time, query_chunk rows of it:
    pairs never become rows.
    """

    def head(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("patch", ignore_index=True)
        q, k = (np.stack(pdf[c].to_list()).astype(float) for c in ("q", "k"))
        total = np.zeros(len(k))
        for i in range(0, len(q), query_chunk):
            logits = q[i : i + query_chunk] @ k.T / np.sqrt(k.shape[1])
            logits = np.exp(logits - logits.max(1, keepdims=True))
            total += (logits / logits.sum(1, keepdims=True)).sum(0)
        return pdf[["video_id", "frame", "patch"]].assign(got=total / len(q))

    schema = f"video_id {qk.schema['video_id'].dataType.simpleString()}, frame int, patch int, got double"
    per_head = qk.select(*FRAME, "head", "patch", "q", "k").groupBy(*FRAME, "head").applyInPandas(head, schema)
    return per_head.groupBy(*FRAME, "patch").agg(F.avg("got").alias("attention"))


def pooled_attention(attention: DataFrame, merge_unit: int) -> DataFrame:
    """(video_id, frame, token, attention): the mean of each run of merge_unit patches."""
    pooled = attention.groupBy(*FRAME, F.floor(F.col("patch") / merge_unit).cast("int").alias("token"))
    return pooled.agg(F.avg("attention").alias("attention"))


def ragged_offsets(grid: DataFrame, total_rows: int | None = None) -> DataFrame:
    """grid(video_id, temporal, height, width) with start and stop, each video's rows in the concatenated batch.

    total_rows: fail unless the videos use exactly these. Sums run within runs of RUN ids, and over the runs' totals:
    a row for each run passes through one task, not one for each video.
    """
    size = F.col("temporal").cast("long") * F.col("height") * F.col("width")
    rows = grid.withColumn("_run", F.floor(F.col("video_id") / RUN)).withColumn("_size", size)
    ahead = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("_run").agg(F.sum("_size").alias("_sum")).select(F.col("_run").alias("_of"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy()).alias("_used"))
    inside = Window.partitionBy("_run").orderBy("video_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("stop", F.sum("_size").over(inside)).join(runs, F.col("_run") == F.col("_of")).withColumn("stop", F.col("_ahead") + F.col("stop"))
    out = out.withColumn("start", F.col("stop") - F.col("_size"))
    if total_rows is not None:
        out = out.withColumn("stop", required(F.col("stop"), F.col("_used") == total_rows, "rows are left over or missing"))
    return out.select("video_id", "temporal", "height", "width", "start", "stop")


def aligned(tokens: DataFrame, attention: DataFrame) -> DataFrame:
    """tokens with their attention; fails at run time where one side lacks a row."""
    both = tokens.join(attention.withColumn("_there", F.lit(True)), ["video_id", "frame", "token"], "full")
    fine = F.col("_there").isNotNull() & F.col("vec").isNotNull()
    return both.withColumn("attention", required(F.col("attention"), fine, "tokens and attention don't match", "double")).drop("_there")
