"""Density-peak clustering with k nearest neighbours, within frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokensieve.functions import vectors as V
from tokensieve.operators.segment import DIGITS
from tokensieve.operators.select import matrix

POINT = ("video_id", "frame", "token")


def euclid_pairs(points: DataFrame) -> DataFrame:
    """(video_id, frame, i, j, dist): Euclidean distances over the root of the dimension; a report, not a step."""
    a = points.select("video_id", "frame", F.col("token").alias("i"), F.col("vec").alias("a"))
    b = points.select("video_id", "frame", F.col("token").alias("j"), F.col("vec").alias("b"))
    dist = V.distance(F.col("a"), F.col("b")) / F.sqrt(F.size("a").cast("double"))
    return a.join(b, ["video_id", "frame"]).select("video_id", "frame", "i", "j", F.round(dist, DIGITS).alias("dist"))


def distances(x: np.ndarray) -> np.ndarray:
    d = np.empty((len(x), len(x)))
    for i in range(0, len(x), 256):  # differences, not products, so that equal vectors are at distance 0
        d[i : i + 256] = [np.sqrt(((x - v) ** 2).sum(1)) for v in x[i : i + 256]]
    return np.round(d / np.sqrt(x.shape[1]), DIGITS)


def density_peaks(x: np.ndarray, clusters: int, k: int = 7, valid: np.ndarray | None = None, sentinel: float | None = None) -> dict[str, np.ndarray]:
    """Neighbours, density, delta, score, centres (best first) and the cluster of each point.

    Density is exp of the mean of minus the squared distances to the k nearest, the point itself included; delta the
    distance to the nearest denser point, or the greatest distance there is. Points that aren't valid are at the
    sentinel from all others (one more than the greatest distance, of all frames where it is given) and have no density.
    Best value, then least index.
    """
    if not 1 <= clusters <= len(x):
        raise ValueError("the number of clusters must lie between 1 and the number of points")
    k = min(max(1, k), len(x))
    d = distances(x)
    if valid is not None:
        d[:, ~valid] = (d.max() if sentinel is None else sentinel) + 1
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, 1)
    density = np.round(np.exp(-(near**2).mean(1)), DIGITS)
    if valid is not None:
        density[~valid] = 0
    higher = density[None, :] > density[:, None]
    delta = np.where(higher, d, d.max()).min(1)
    score = np.round(delta * density, DIGITS)
    centres = np.argsort(-score, kind="stable")[:clusters]
    cluster = d[:, centres].argmin(1)
    cluster[centres] = np.arange(clusters)
    return {"neighbours": order, "density": density, "delta": delta, "score": score, "centres": centres, "cluster": cluster}


def greatest_distance(points: DataFrame) -> float:
    """The greatest distance between points of one frame; 0 without any."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [distances(matrix(pdf["vec"])).max()]})

    most = points.select("video_id", "frame", "vec").groupBy("video_id", "frame").applyInPandas(frame, "d double").agg(F.max("d")).first()[0]
    return most or 0.0


def clustered_points(points: DataFrame, k: int = 7) -> DataFrame:
    """(video_id, frame, token, density, delta, score, cluster, centre) of points with their frame's cluster count n.

    centre: the point is its cluster's centre; clusters are numbered by score. An optional column valid masks points:
    they are farther from all others than any two points of one frame are in the whole table, which takes a pass of its own.
    """
    masked = "valid" in points.columns
    greatest = greatest_distance(points) if masked else None

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        valid = pdf["valid"].to_numpy(bool) if masked else None
        got = density_peaks(matrix(pdf["vec"]), int(pdf["n"].iloc[0]), k, valid, greatest)
        centre = np.zeros(len(pdf), bool)
        centre[got["centres"]] = True
        return pdf[list(POINT)].assign(density=got["density"], delta=got["delta"], score=got["score"], cluster=got["cluster"], centre=centre)

    rows = points.select(*POINT, "vec", "n", *(["valid"] if masked else []))
    schema = "video_id long, frame int, token int, density double, delta double, score double, cluster int, centre boolean"
    return rows.groupBy("video_id", "frame").applyInPandas(frame, schema)


def nearest_neighbours(points: DataFrame, k: int = 7) -> DataFrame:
    """(video_id, frame, token, rank, neighbour, dist): the k nearest of each point, itself included."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        d = distances(matrix(pdf["vec"]))
        order = np.argsort(d, axis=1, kind="stable")[:, : min(max(1, k), len(d))]
        i, r = (x.ravel() for x in np.meshgrid(np.arange(len(d)), np.arange(order.shape[1]), indexing="ij"))
        tokens = pdf["token"].to_numpy()
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "frame": pdf["frame"].iloc[0], "token": tokens[i], "rank": r, "neighbour": tokens[order[i, r]], "dist": d[i, order[i, r]]})

    return points.select(*POINT, "vec").groupBy("video_id", "frame").applyInPandas(frame, "video_id long, frame int, token int, rank int, neighbour int, dist double")


def cluster_means(points: DataFrame, counts: DataFrame) -> DataFrame:
    """(video_id, frame, token, vec): each frame's points reduced to n, the mean of each cluster at its centre.

    counts(video_id, frame, n). No points for n = 0, the points themselves where n is all of them, else clusters with
    min(7, n) neighbours.
    """

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        n = int(pdf["n"].iloc[0])
        if n >= len(pdf):
            return pdf[[*POINT, "vec"]]
        x = matrix(pdf["vec"])
        got = density_peaks(x, n, min(7, n))
        total = np.zeros((n, x.shape[1]))
        np.add.at(total, got["cluster"], x)
        total /= np.bincount(got["cluster"], minlength=n)[:, None]
        return pdf.loc[got["centres"], list(POINT)].assign(vec=list(total))

    rows = points.select(*POINT, "vec").join(counts.filter("n > 0").select("video_id", "frame", "n"), ["video_id", "frame"])
    return rows.groupBy("video_id", "frame").applyInPandas(frame, "video_id long, frame int, token int, vec array<double>")
