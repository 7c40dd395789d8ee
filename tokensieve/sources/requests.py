"""Request logs: streamed responses, and the log that the events table stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "run long, seq long, ok boolean, error string, latency_s double, ttft_s double, chunks long, output_tokens long"


def events_as_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, seq, ok, error, latency_s, ttft_s, chunks, output_tokens) of the events table; four runs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    failed = F.col("event_type") == "error"
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    chunks = (F.col("event_id") % 7 + 1).cast("long")
    return e.select(
        (F.col("user_id") % 4).alias("run"),
        F.col("event_id").alias("seq"),
        (~failed).alias("ok"),
        F.when(failed, F.concat(F.lit("error "), F.col("event_id").cast("string"))).alias("error"),
        F.col("value").alias("latency_s"),
        F.when(F.col("event_type") != "view", F.col("value") / 2).alias("ttft_s"),
        chunks.alias("chunks"),
        F.when(tokens == 0, chunks).otherwise(tokens).alias("output_tokens"),
    )


def events_as_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request, seq, ts, value): the events as lines of event streams, a request for each user.

    Even events are data lines with a count of chunks, every third of them with usage, and every 23rd is cut off; the rest
    are comments or ends.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("string"), F.lit("0"))
    usage = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "usage": {"completion_tokens": '), k, F.lit("}"))).otherwise("")
    data = F.concat(F.lit('data: {"id": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 46 != 0, F.concat(usage, F.lit("}"))).otherwise(""))
    line = F.when(F.col("event_id") % 2 == 0, data).when(F.col("event_id") % 5 == 0, "data: [DONE]").otherwise(": ping")
    return e.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), "ts", line.alias("value"))


def event_stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """(request, seq, ts, value): the lines of stored event streams, one request to a file, in their order.

    ts is the time at which the file was stored; a file is read by one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("request"), F.col("_metadata.file_modification_time").alias("ts"), "value")
    lines = whole.select("request", "ts", F.posexplode(F.split("value", "\r?\n")).alias("seq", "value"))
    return lines.select("request", F.col("seq").cast("long"), "ts", "value").filter("value != ''")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored JSON reports, one object per file, as report_sink and others write them."""
    return spark.read.option("multiLine", "true").json(path)
