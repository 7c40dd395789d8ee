"""Attention-weighted farthest-point selection within frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.functions import vectors as V

#: Calibrated distances are compared after rounding to so many digits.
DIGITS, SCALE = 6, 1e6
TOKEN = ("video_id", "frame", "token")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def cosine_pairs(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, i, j, dist): cosine distances of all pairs within each frame; a report, not a step."""
    u = tokens.select("video_id", "frame", "token", V.unit(F.col("vec")).alias("u"), *(["attention"] if "attention" in tokens.columns else []))
    a = u.select("video_id", "frame", F.col("token").alias("i"), F.col("u").alias("a"))
    b = u.select("video_id", "frame", F.col("token").alias("j"), F.col("u").alias("b"), *([F.col("attention")] if "attention" in u.columns else []))
    pairs = a.join(b, ["video_id", "frame"]).withColumn("dist", F.lit(1.0) - V.dot(F.col("a"), F.col("b")))
    return pairs.drop("a", "b")


def calibrated_distances(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, i, j, cal): the distance weighed by the attention of the candidate j."""
    pairs = cosine_pairs(tokens)
    return pairs.select("video_id", "frame", "i", "j", F.round(F.col("dist") * F.col("attention") * SCALE, DIGITS).alias("cal"))


def _calibrated(x: np.ndarray, attention: np.ndarray) -> np.ndarray:
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), V.LEAST_NORM)
    return np.round((1.0 - u @ u.T) * (attention * SCALE), DIGITS)


def first_pick(cal: np.ndarray) -> tuple[int, np.ndarray]:
    """The candidate whose second-least distance to any token is greatest, and those distances."""
    second = np.sort(cal, axis=0)[1] if len(cal) > 1 else cal[0]
    return int(second.argmax()), second


def greedy(cal: np.ndarray, count: int) -> list[int]:
    """The picks in order: each time the candidate farthest from all picked ones. A running minimum suffices."""
    if count == 0:
        return []
    picks = [first_pick(cal)[0]]
    least = cal[picks[0]].copy()
    while len(picks) < count:
        least[picks] = -1.0
        picks.append(int(least.argmax()))
        least = np.minimum(least, cal[picks[-1]])
    return picks


def marked_tokens(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """tokens(video_id, frame, token, vec, attention) with pick: the turn in which their frame selects them, or null.

    counts(video_id, frame, n). Frames are independent: one shuffle brings a frame's tokens together, its distances
    stay a matrix.
    """

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        n = int(pdf["n"].iloc[0])
        if n > len(pdf):
            raise ValueError("more tokens are wanted than a frame has")
        picks = greedy(_calibrated(matrix(pdf["vec"]), pdf["attention"].to_numpy(float)), n)
        turn = pd.array([None] * len(pdf), "Int32")
        turn[picks] = range(n)
        return pdf[[*TOKEN, "vec", "attention"]].assign(pick=turn)

    wanted = tokens.join(counts.select("video_id", "frame", "n"), ["video_id", "frame"]).select(*TOKEN, "vec", "attention", "n")
    return wanted.groupBy("video_id", "frame").applyInPandas(frame, "video_id long, frame int, token int, vec array<double>, attention double, pick int")


def diverse_tokens(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(video_id, frame, token, pick): the tokens that each frame selects, pick being their turn from 0."""
    return marked_tokens(tokens, counts).filter("pick IS NOT NULL").select(*TOKEN, "pick")


def first_picks(tokens: DataFrame) -> DataFrame:
    """(video_id, frame, token, nearest): each frame's first pick and its distance to the nearest other token."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        pick, second = first_pick(_calibrated(matrix(pdf["vec"]), pdf["attention"].to_numpy(float)))
        return pdf.loc[[pick], list(TOKEN)].assign(nearest=second[pick])

    return tokens.select(*TOKEN, "vec", "attention").groupBy("video_id", "frame").applyInPandas(frame, "video_id long, frame int, token int, nearest double")
