"""Compression of videos that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tokensieve.config import CompressionConfig
from tokensieve.operators.compress import compress

TOKENS = "video_id long, frame int, token int, vec array<double>, attention double"


def compress_stream(spark: SparkSession, source: str, out: str, checkpoint: str, config: CompressionConfig | None = None, files_per_trigger: int | None = None) -> StreamingQuery:
    """Compress the token tables that appear as Parquet files below source; a file holds whole videos.

    A video can only be compressed when all its frames are there, so files are the unit of arrival. Each micro-batch
    goes through compress() and is written to out/batch=<n>; a batch that runs again after a failure replaces its own
    output. The query stops when all files that are there have been read.
    """
    reader = spark.readStream.schema(TOKENS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, number: int) -> None:
        compress(batch, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reader.parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_requests(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, run, requests, failed, output_tokens) of a stream of requests with ts; rows later than `late` are left out.

    ts may be a timestamp without zone; watermarks need one with it.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width).alias("window"), "run").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("failed"), F.sum("output_tokens").alias("output_tokens"))
