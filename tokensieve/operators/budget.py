"""Targets and their proportional allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.functions.checks import required


def allocate(capacities: DataFrame, budget: str | int, by: str = "frame") -> DataFrame:
    """(video_id, by, capacity, n): the largest-remainder split of each video's budget in proportion to capacity.

    What rounding down leaves goes to the largest fractions, then the most room, then the least index; none gets more
    than its capacity. A budget below 0 or above all capacity fails at run time. budget: a column's name or a number.
    """
    video = Window.partitionBy("video_id")
    b = (F.col(budget) if isinstance(budget, str) else F.lit(budget)).cast("long")
    rows = capacities.select("video_id", by, F.col("capacity").cast("long").alias("capacity"), b.alias("_b")).withColumn("_all", F.sum("capacity").over(video))
    rows = rows.withColumn("_b", required(F.col("_b"), (F.col("_b") >= 0) & (F.col("_b") <= F.col("_all")), "the budget exceeds the capacity"))
    raw = F.when(F.col("_all") > 0, (F.col("_b") * F.col("capacity")).cast("double") / F.greatest("_all", F.lit(1))).otherwise(0.0)
    rows = rows.withColumn("_raw", raw).withColumn("_n", F.least("capacity", F.floor("_raw")))
    rows = rows.withColumn("_left", F.col("_b") - F.sum("_n").over(video))
    room = F.col("capacity") - F.col("_n")
    order = Window.partitionBy("video_id").orderBy((room > 0).desc(), (F.col("_raw") - F.col("_n")).desc(), room.desc(), by)
    extra = (F.row_number().over(order) <= F.col("_left")) & (room > 0)
    return rows.select("video_id", by, "capacity", (F.col("_n") + extra.cast("long")).alias("n"))


def library_target(total: Column, ratio: float) -> Column:
    """The ratio's share of total, rounded up."""
    return F.ceil(total.cast("double") * F.lit(float(ratio))).cast("long")


def service_target(frames: Column, tokens_per_frame: Column, ratio: float) -> Column:
    """What a service keeps that is told the pruning rate: rounded down, and a frame's tokens at least."""
    rate = 1.0 - float(ratio)
    kept = F.floor((frames * tokens_per_frame).cast("double") * F.lit(1.0 - rate)).cast("long")
    return F.greatest(tokens_per_frame.cast("long"), kept)


def diverse_share(target: Column, alpha: float) -> Column:
    """How much of the target goes to the diverse selection."""
    return F.least(target, F.ceil(target.cast("double") * F.lit(float(alpha))).cast("long"))
