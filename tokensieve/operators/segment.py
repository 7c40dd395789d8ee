"""Cutting videos into segments where successive frames differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.functions import vectors as V

#: Similarities and distances are compared after rounding, so that equal ones tie whatever order they were summed in.
DIGITS = 9


def frame_means(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, vec): the mean over all tokens of a frame."""
    return V.group_means(tokens, {"video_id": "long", "frame": "int"}).drop("members")


def transitions(frames: DataFrame) -> DataFrame:
    """(video_id, frame, sim): the cosine of each frame but the last with the next."""
    order = Window.partitionBy("video_id").orderBy("frame")
    pairs = frames.withColumn("u", V.unit(F.col("vec"))).withColumn("next", F.lead("u").over(order))
    return pairs.filter("next IS NOT NULL").select("video_id", "frame", F.round(V.dot(F.col("u"), F.col("next")), DIGITS).alias("sim"))


def cuts(steps: DataFrame, threshold: float = 0.9, min_segments: int = 4) -> DataFrame:
    """(video_id, frame, sim, cut): whether a segment ends at the frame.

    It does where the similarity is below the threshold. If that makes fewer segments than min_segments, or than there
    are frames, the least similar of the other transitions are cut too, the first on ties.
    """
    video = Window.partitionBy("video_id")
    below = F.col("sim") < F.lit(float(threshold))
    missing = F.least(F.lit(min_segments), F.count(F.lit(1)).over(video) + 1) - (F.count_if(below).over(video) + 1)
    rank = F.row_number().over(Window.partitionBy("video_id", below).orderBy("sim", "frame"))
    return steps.select("video_id", "frame", "sim", (below | (rank <= missing)).alias("cut"))


def segments(frames: DataFrame, threshold: float = 0.9, min_segments: int = 4) -> DataFrame:
    """(video_id, frame, seg_id) for each frame; segments count from 0."""
    ended = cuts(transitions(frames), threshold, min_segments).select("video_id", F.col("frame").alias("before"), "cut")
    order = Window.partitionBy("video_id").orderBy("frame")
    prior = frames.select("video_id", "frame", F.lag("frame").over(order).alias("before"))
    marked = prior.join(ended, ["video_id", "before"], "left").withColumn("new", F.coalesce(F.col("cut"), F.lit(False)).cast("int"))
    return marked.select("video_id", "frame", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("seg_id"))


def segment_lengths(of_frames: DataFrame) -> DataFrame:
    """(video_id, seg_id, start_frame, length) of (video_id, frame, seg_id)."""
    return of_frames.groupBy("video_id", "seg_id").agg(F.min("frame").alias("start_frame"), F.count(F.lit(1)).alias("length"))
