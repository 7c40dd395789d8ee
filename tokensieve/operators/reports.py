"""Reports on load tests: what requests took, and which configuration did best."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DATA, END = "data: ", "data: [DONE]"
USAGE = "usage struct<completion_tokens: long>"


def data_events(lines: DataFrame) -> DataFrame:
    """(request, seq, ts, event, fine): the decoded data lines of event streams; comments and the end are left out.

    fine: the line holds a JSON object.
    """
    kept = lines.filter(F.col("value").startswith(DATA) & (F.col("value") != END)).withColumn("_json", F.substring("value", len(DATA) + 1, 1 << 30))
    fine = F.try_parse_json("_json").isNotNull() & F.ltrim("_json").startswith("{")
    return kept.select("request", "seq", "ts", F.from_json("_json", USAGE).alias("event"), fine.alias("fine"))


def responses(lines: DataFrame) -> DataFrame:
    """(request, first_ts, chunks, output_tokens, error) of each request with lines: seq orders them.

    Every data event is a chunk; the last usage that names a count gives the tokens, chunks stand in for none or 0. A
    data line that is no JSON object ends its request: it names the error, and neither it nor later lines are chunks.
    """
    request = Window.partitionBy("request")
    events = data_events(lines).withColumn("tokens", F.col("event.usage.completion_tokens")).withColumn("bad", F.min(F.when(~F.col("fine"), F.col("seq"))).over(request))
    read = F.col("bad").isNull() | (F.col("seq") < F.col("bad"))
    last = F.max(F.when(read & F.col("tokens").isNotNull(), F.struct("seq", "tokens")))["tokens"]
    out = events.groupBy("request").agg(F.min("ts").alias("first_ts"), F.count_if(read).alias("chunks"), last.alias("tokens"), F.min("bad").alias("bad"))
    out = lines.select("request").distinct().join(out, "request", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    error = F.when(F.col("bad").isNotNull(), F.concat(F.lit("no JSON object in line "), F.col("bad").cast("string")))
    return out.select("request", "first_ts", "chunks", token_count(F.col("tokens"), F.col("chunks")).alias("output_tokens"), error.alias("error"))


def token_count(tokens: Column, chunks: Column) -> Column:
    """The reported number of tokens; the number of chunks if that is missing or 0."""
    return F.coalesce(F.nullif(tokens, F.lit(0)), chunks)


def request_log(timed: DataFrame) -> DataFrame:
    """(request, ok, error, latency_s, ttft_s) of (request, started, first, ended, error), times in seconds."""
    return timed.select("request", F.col("error").isNull().alias("ok"), "error", (F.col("ended") - F.col("started")).alias("latency_s"), (F.col("first") - F.col("started")).alias("ttft_s"))


def first_errors(requests: DataFrame, most: int = 10) -> DataFrame:
    """(run, seq, error): each run's first failures."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    return requests.filter(~F.col("ok")).withColumn("_rank", rank).filter(F.col("_rank") <= most).select("run", "seq", "error")


def request_report(requests: DataFrame, elapsed: DataFrame, concurrency: int = 16) -> DataFrame:
    """One row per run: counts, rates, mean and median of latency and time to the first token, first errors.

    requests(run, seq, ok, error, latency_s, ttft_s, output_tokens); elapsed(run, elapsed_s). Only requests that
    succeeded are timed; statistics of none are null.
    """
    ok = F.col("ok")
    per_run = requests.groupBy("run").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("_tokens"),
        F.avg(F.when(ok, F.col("latency_s"))).alias("latency_mean_s"),
        F.median(F.when(ok, F.col("latency_s"))).alias("latency_p50_s"),
        F.avg(F.when(ok, F.col("ttft_s"))).alias("ttft_mean_s"),
        F.median(F.when(ok, F.col("ttft_s"))).alias("ttft_p50_s"),
    )
    errors = first_errors(requests).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda x: x["error"]).alias("errors"))
    rows = per_run.join(elapsed, "run").join(errors, "run", "left")
    return rows.select(
        "run",
        "requests",
        "successful",
        (F.col("requests") - F.col("successful")).alias("failed"),
        F.lit(concurrency).alias("concurrency"),
        "elapsed_s",
        F.try_divide("successful", "elapsed_s").alias("requests_per_s"),
        F.try_divide("_tokens", "elapsed_s").alias("output_tokens_per_s"),
        "latency_mean_s",
        "latency_p50_s",
        "ttft_mean_s",
        "ttft_p50_s",
        F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
    )


def config_grid(spark: SparkSession, dp: tuple[int, ...] = (1, 2, 4, 8), max_num_seqs: tuple[int, ...] = (16, 32, 64), max_num_batched_tokens: tuple[int, ...] = (16384, 32768)) -> DataFrame:
    """(run_no, name, dp, max_num_seqs, max_num_batched_tokens): all combinations, the last option changing fastest."""
    one = spark.range(1).select(F.posexplode(F.array(*map(F.lit, dp))).alias("_i", "dp"))
    two = one.select("*", F.posexplode(F.array(*map(F.lit, max_num_seqs))).alias("_j", "max_num_seqs"))
    all_ = two.select("*", F.posexplode(F.array(*map(F.lit, max_num_batched_tokens))).alias("_k", "max_num_batched_tokens"))
    number = (F.col("_i") * len(max_num_seqs) + F.col("_j")) * len(max_num_batched_tokens) + F.col("_k")
    name = F.format_string("dp%d-seqs%d-tokens%d", "dp", "max_num_seqs", "max_num_batched_tokens")
    return all_.select(number.alias("run_no"), name.alias("name"), "dp", "max_num_seqs", "max_num_batched_tokens")


def with_config(reports: DataFrame, grid: DataFrame) -> DataFrame:
    """reports(run_no, ...) with their configuration as a struct."""
    config = grid.select("run_no", F.struct("dp", "max_num_seqs", "max_num_batched_tokens").alias("config"))
    return reports.join(config, "run_no")


def best_run(reports: DataFrame) -> DataFrame:
    """Of the reports without failures the one with most output tokens a second, the first on ties; or no row."""
    return reports.filter("failed = 0").orderBy(F.desc("output_tokens_per_s"), "run_no").limit(1)


def summary(reports: DataFrame) -> DataFrame:
    """One row: best (null if every run had failures) and runs in their order."""
    fields = F.struct(*reports.columns)
    best = best_run(reports).agg(F.first(fields).alias("best"))
    runs = reports.agg(F.transform(F.array_sort(F.collect_list(F.struct("run_no", fields.alias("r")))), lambda x: x["r"]).alias("runs"))
    return best.crossJoin(runs)


def checked_best(reports: DataFrame) -> dict:
    """The best run as a dict; raises if there is none."""
    row = best_run(reports).first()
    if row is None:
        raise LookupError("no configuration ran without failures")
    return row.asDict(recursive=True)


def report_sink(report: DataFrame, path: str) -> None:
    """Write a report of one row as an indented JSON file."""
    row = json.loads(report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    to.write_text(json.dumps(row, indent=2) + "\n", encoding="utf-8")


def chat_requests(prompts: DataFrame, model: str, max_tokens: int = 64, stream: bool = False) -> DataFrame:
    """(request, body): JSON chat requests of (request, prompt, videos array, image).

    Videos come before the prompt; an image only where there is no video.
    """
    part = "array<struct<type: string, text: string, video_url: struct<url: string>, image_url: struct<url: string>>>"
    videos = F.transform(F.coalesce("videos", F.array().cast("array<string>")), lambda u: F.struct(F.lit("video_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(u.alias("url")).alias("video_url"), F.lit(None).cast("struct<url: string>").alias("image_url")))
    image = F.array(F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("struct<url: string>").alias("video_url"), F.struct(F.col("image").alias("url")).alias("image_url")))
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("prompt").alias("text"), F.lit(None).cast("struct<url: string>").alias("video_url"), F.lit(None).cast("struct<url: string>").alias("image_url")))
    media = F.when(F.size(videos) > 0, videos.cast(part)).when(F.col("image").isNotNull(), image.cast(part)).otherwise(F.array().cast(part))
    content = F.concat(media, text.cast(part))
    extra = [F.lit(True).alias("stream"), F.struct(F.lit(True).alias("include_usage")).alias("stream_options")] if stream else []
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"), F.lit(0).alias("temperature"), F.lit(max_tokens).alias("max_tokens"), *extra)
    return prompts.select("request", F.to_json(body).alias("body"))
