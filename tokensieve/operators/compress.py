"""Compressing videos to an exact number of tokens.

Most of a video's budget goes to diverse tokens of each frame; the rest is shared by what remains after merging along
time, clustered within frames; tokens of high attention fill what is still missing. All videos go through together. What
later steps read more than once, the marked and the merged tokens, is stored in the shared folder: nothing is computed
twice, plans stay small, and a lost executor costs the step at hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokensieve.config import CompressionConfig
from tokensieve.functions.checks import required
from tokensieve.operators import budget as B
from tokensieve.operators.cluster import cluster_means
from tokensieve.operators.merge import merged_tokens
from tokensieve.operators.segment import frame_means, segments
from tokensieve.operators.select import marked_tokens
from tokensieve.sources.scratch import stored

OUT = ("video_id", "frame", "token", "vec")


def video_targets(tokens: DataFrame, config: CompressionConfig, target_tokens: int | Column | None = None) -> DataFrame:
    """(video_id, frames, tpf, total, target, diverse): sizes, the target and the diverse selection's share of it.

    target_tokens: one number for all videos, or an expression over frames, tpf and total, as service_target() makes.
    Frames and tokens are numbered from 0 and every frame has as many tokens as the others, or the query fails; so
    does a target outside 1..total.
    """
    sizes = tokens.groupBy("video_id").agg((F.max("frame") + 1).cast("long").alias("frames"), (F.max("token") + 1).cast("long").alias("tpf"), F.count(F.lit(1)).alias("total"))
    given = target_tokens if isinstance(target_tokens, Column) else F.lit(target_tokens)
    target = given.cast("long") if target_tokens is not None else B.library_target(F.col("total"), config.retention_ratio)
    even = required(target, F.col("total") == F.col("frames") * F.col("tpf"), "frames must have equally many tokens")
    rows = sizes.withColumn("target", required(even, target.between(1, F.col("total")), "the target must lie between 1 and the number of tokens"))
    return rows.withColumn("diverse", B.diverse_share(F.col("target"), config.alpha))


def anchored(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(video_id, anchor, frame, token, vec): anchor numbers a video's tokens."""
    tpf = targets.select("video_id", F.col("tpf").alias("_tpf"))
    return rows.join(tpf, "video_id").select("video_id", (F.col("frame") * F.col("_tpf") + F.col("token")).cast("long").alias("anchor"), "frame", "token", "vec")


def compress(tokens: DataFrame, config: CompressionConfig | None = None, target_tokens: int | Column | None = None) -> DataFrame:
    """(video_id, anchor, frame, token, vec): exactly the target's number of tokens of each video.

    tokens(video_id, frame, token, vec, attention). Selected tokens keep their vector, a cluster's token has the mean
    of the cluster's merged tokens; anchors are unique within a video, or the call fails. With ratio 1, or where the
    target is all of a video, its tokens come back as they are. The result is stored, so it is counted once and read as
    often as one likes.
    """
    config = config or CompressionConfig()
    targets = video_targets(tokens, config, target_tokens)
    if config.retention_ratio == 1 and target_tokens is None:
        return anchored(tokens, targets)
    whole = tokens.join(targets.filter("target = total").select("video_id"), "video_id", "left_semi")
    some = targets.filter("target < total")

    frames = some.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frames").cast("int") - 1)))
    counts = B.allocate(frames.select("video_id", "frame", F.col("tpf").alias("capacity"), "diverse"), "diverse")
    marked = stored(marked_tokens(tokens, counts), "marked")
    picked = marked.filter("pick IS NOT NULL").select(*OUT)
    out = whole.select(*OUT).unionByName(picked)
    if config.alpha < 1:
        of_frame = segments(frame_means(marked), config.segment_threshold, config.min_segments)
        available = marked.filter("pick IS NULL").join(of_frame, ["video_id", "frame"]).select(*OUT, "seg_id")
        merged = stored(merged_tokens(available, config.temporal_threshold), "merged")
        rooms = merged.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("capacity"))
        shares = rooms.join(some.select("video_id", (F.col("target") - F.col("diverse")).alias("_rest")), "video_id")
        shares = shares.withColumn("_share", F.least("_rest", F.sum("capacity").over(Window.partitionBy("video_id"))))
        context = cluster_means(merged, B.allocate(shares, "_share"))
        out = out.unionByName(context)
        out = out.unionByName(attention_fill(marked, context, some))
    result = stored(anchored(out, targets), "retained")
    if not missed(result, targets).isEmpty():
        raise ValueError("anchors repeat, or the target is missed")
    return result


def missed(result: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets(video_id, target) of which result hasn't exactly as many distinct anchors, and rows."""
    found = result.groupBy("video_id").agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct("anchor").alias("_distinct"))
    fine = F.coalesce((F.col("_rows") == F.col("target")) & (F.col("_distinct") == F.col("target")), F.lit(False))
    return targets.select("video_id", "target").join(found, "video_id", "left").filter(~fine)


def attention_fill(marked: DataFrame, context: DataFrame, targets: DataFrame) -> DataFrame:
    """(video_id, frame, token, vec): the tokens of highest attention, not output yet, that the target still misses.

    marked has pick; context(video_id, frame, token) is output as well. Tokens that were merged into another may come.
    """
    keys = ["video_id", "frame", "token"]
    got = context.groupBy("video_id").agg(F.count(F.lit(1)).alias("got"))
    missing = targets.join(got, "video_id", "left").select("video_id", (F.col("target") - F.col("diverse") - F.coalesce("got", F.lit(0))).alias("missing")).filter("missing > 0")
    rest = marked.filter("pick IS NULL").join(missing, "video_id").join(context.select(*(F.col(c).alias(c) for c in keys)), keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("attention"), "frame", "token"))
    return rest.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("missing")).select(*OUT)


def asserted(result: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(video_id, total, target) with retained; fails at run time if anchors repeat or the target is missed."""
    found = result.groupBy("video_id").agg(F.count(F.lit(1)).alias("retained"), F.countDistinct("anchor").alias("_distinct"))
    fine = F.coalesce((F.col("retained") == F.col("target")) & (F.col("_distinct") == F.col("target")), F.lit(False))
    retained = required(F.col("retained"), fine, "anchors repeat, or the target is missed")
    return targets.join(found, "video_id", "left").select("video_id", "total", "target", retained.alias("retained"))


def retention_mask(tokens: DataFrame, result: DataFrame) -> DataFrame:
    """(video_id, frame, token, kept) for each token."""
    keys = ["video_id", "frame", "token"]
    there = result.select(*(F.col(c).alias(c) for c in keys)).withColumn("_there", F.lit(True))
    return tokens.select(*keys).join(there, keys, "left").select(*keys, F.coalesce("_there", F.lit(False)).alias("kept"))


def tokens_per_frame(mask: DataFrame) -> DataFrame:
    """(video_id, frame, n) of a retention mask; frames that keep nothing have 0."""
    return mask.groupBy("video_id", "frame").agg(F.count_if("kept").alias("n"))


def with_timestamps(result: DataFrame, frame_ts: DataFrame) -> DataFrame:
    """result with the time of each token's frame; frame_ts(video_id, frame, ts) passes through."""
    return result.join(frame_ts, ["video_id", "frame"], "left")
