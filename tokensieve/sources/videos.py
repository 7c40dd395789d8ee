"""Token tables: (video_id, frame, token, vec, attention)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokensieve.functions.checks import required
from tokensieve.operators.attention import received_attention
from tokensieve.sources.scratch import stored

#: The derived videos: embeddings behind each and the least number of videos; frames, tokens of a frame, frames of a scene.
BEHIND, LEAST_VIDEOS, FRAMES, TOKENS, SCENE = 100, 3, 20, 20, 5


def derived_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, frame, token, vec): smooth videos made of the embeddings, without attention.

    A token is the scene's base vector plus a quarter of a drifting one; ids wrap around the table's size. There are as
    many videos as it takes to use every embedding, one for each BEHIND of them.
    """
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    size = table.count()
    videos = max(LEAST_VIDEOS, math.ceil(size / BEHIND))
    grid = spark.range(videos * FRAMES * TOKENS).select(
        F.floor(F.col("id") / (FRAMES * TOKENS)).cast("long").alias("video_id"),
        (F.floor(F.col("id") / TOKENS) % FRAMES).cast("int").alias("frame"),
        (F.col("id") % TOKENS).cast("int").alias("token"),
    )
    shift = F.col("video_id") * 137
    m = F.lit(size)
    grid = grid.select(
        "video_id",
        "frame",
        "token",
        ((F.floor(F.col("frame") / SCENE) * TOKENS + F.col("token") + shift) % m).alias("base"),
        (((F.col("frame") * TOKENS + F.col("token")) * 7 + 3 + shift) % m).alias("drift"),
    )
    grid = grid.join(table.select(F.col("vec_id").alias("base"), F.col("e").alias("b")), "base")
    grid = grid.join(table.select(F.col("vec_id").alias("drift"), F.col("e").alias("d")), "drift")
    return grid.select("video_id", "frame", "token", F.zip_with("b", "d", lambda x, y: x + 0.25 * y).alias("vec"))


def derived_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived tokens with the attention that each receives from its frame.

    Stands for a stored table, so its rows are stored: plans that read them often needn't hold how they came about.
    """
    tokens = derived_tokens(spark, sf_dir)
    heads = tokens.select("video_id", "frame", F.lit(0).alias("head"), F.col("token").alias("patch"), F.col("vec").alias("q"), F.col("vec").alias("k"))
    weights = received_attention(heads).withColumnRenamed("patch", "token")
    return stored(tokens.join(weights, ["video_id", "frame", "token"]), "videos")


def checked_tokens(tokens: DataFrame) -> DataFrame:
    """tokens, failing at run time where attention is missing or negative, or a vector is."""
    fine = F.col("attention").isNotNull() & (F.col("attention") >= 0) & F.col("vec").isNotNull()
    return tokens.withColumn("attention", required(F.col("attention"), fine, "a token lacks its vector or its attention", "double"))
