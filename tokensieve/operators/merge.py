"""Merging tokens along time: a forest over successive frames of a segment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.functions import vectors as V
from tokensieve.operators.segment import DIGITS
from tokensieve.operators.select import matrix

TOKEN = ("video_id", "frame", "token")


def best_matches(available: DataFrame) -> DataFrame:
    """(video_id, seg_id, frame, token, parent, sim): each token's most similar token of the frame before.

    available(video_id, seg_id, frame, token, vec): the tokens that may merge; only tokens of one segment match. The
    least token wins ties. A frame meets the one before it as two matrices, so pairs never become rows.
    """
    rows = available.select("video_id", "seg_id", "frame", "token", "vec")
    keys = ("video_id", "seg_id", "at")
    now = rows.withColumn("at", F.col("frame"))
    before = rows.select(*(F.col(c).alias(c) for c in ("video_id", "seg_id", "frame", "token", "vec"))).withColumn("at", F.col("frame") + 1)

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"video_id": [], "seg_id": [], "frame": [], "token": [], "parent": [], "sim": []})
        a, b = a.sort_values("token", ignore_index=True), b.sort_values("token", ignore_index=True)
        u, w = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.LEAST_NORM) for x in (matrix(a["vec"]), matrix(b["vec"])))
        sims = np.round(u @ w.T, DIGITS)
        best = sims.argmax(1)
        return a[["video_id", "seg_id", "frame", "token"]].assign(parent=b["token"].to_numpy()[best], sim=sims[np.arange(len(a)), best])

    schema = "video_id long, seg_id int, frame int, token int, parent int, sim double"
    return now.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(match, schema)


def merge_edges(matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The matches above the threshold: tokens that merge into their parent, one frame earlier."""
    return matches.filter(F.col("sim") > F.lit(float(threshold)))


def forest_roots(available: DataFrame, edges: DataFrame) -> DataFrame:
    """(video_id, frame, token, root_frame, root_token) for each available token; a token without an edge is a root.

    A segment's tree indices, not its vectors, are walked in one pass over its frames.
    """

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "token"], ignore_index=True)
        root: dict[tuple[int, int], tuple[int, int]] = {}
        for f, t, p in zip(pdf["frame"].tolist(), pdf["token"].tolist(), pdf["parent"].tolist(), strict=True):
            root[f, t] = (f, t) if p < 0 else root[f - 1, p]
        found = list(root.values())
        return pdf[list(TOKEN)].assign(root_frame=[f for f, _ in found], root_token=[t for _, t in found])

    rows = available.select("video_id", "seg_id", "frame", "token")
    rows = rows.join(edges.select(*TOKEN, "parent"), list(TOKEN), "left").withColumn("parent", F.coalesce("parent", F.lit(-1)))
    return rows.groupBy("video_id", "seg_id").applyInPandas(segment, "video_id long, frame int, token int, root_frame int, root_token int")


def merged_tokens(available: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(video_id, frame, token, vec, members): the roots, each with the mean over its whole tree."""
    roots = forest_roots(available, merge_edges(best_matches(available), threshold))
    trees = available.select(*TOKEN, "vec").join(roots, list(TOKEN))
    trees = trees.select("video_id", F.col("root_frame").alias("frame"), F.col("root_token").alias("token"), "vec")
    return V.group_means(trees, {"video_id": "long", "frame": "int", "token": "int"})
