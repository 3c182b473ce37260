"""Frozen models over neighbours, and Gaussian processes whose neighbours a kernel chooses."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .drift import _apart, _by_size
from .gaussian import _local
from .joins import knn_ref

#: A layer: its weights (outputs x inputs) and its biases.
Layer = tuple[list[list[float]], list[float]]


def layer_scores(edges: DataFrame, features: list[str], layers: list[Layer], inverse: bool = True) -> DataFrame:
    """edges with s: a small network's single output; relu after every layer but the last.

    inverse: features x enter as 1 / (x + 1e-6), so distances become nearness. A batch is one matrix
    product a layer; the layers, a few numbers, go with the task. A null feature gives a null.
    """
    known = [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]

    @F.arrow_udf(T.DoubleType())
    def score(*columns: pa.Array) -> pa.Array:
        x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in columns], axis=1)
        if inverse:
            x = 1.0 / (x + 1e-6)
        for i, (w, b) in enumerate(known):
            x = x @ w.T + b
            if i < len(known) - 1:
                x = np.maximum(x, 0.0)
        return pa.array(x[:, 0], from_pandas=True)

    return edges.withColumn("s", score(*[F.col(f).cast("double") for f in features]))


def score_weight_model(edges: DataFrame, features: list[str], layers: list[Layer], last: str = "sigmoid", inverse: bool = True) -> DataFrame:
    """station_id, nb_id, w: a frozen model's scores, through a sigmoid or relu, over their sum among a target's neighbours.

    An edge without a score has weight 0.
    """
    if last not in ("sigmoid", "relu"):
        raise ValueError(f"unknown activation {last}")
    s = F.col("s")
    # the branch keeps exp from overflowing
    positive = F.when(s >= 0, 1 / (1 + F.exp(-F.abs(s)))).otherwise(F.exp(-F.abs(s)) / (1 + F.exp(-F.abs(s)))) if last == "sigmoid" else F.greatest(s, F.lit(0.0))
    scored = layer_scores(edges, features, layers, inverse).withColumn("a", F.coalesce(positive, F.lit(0.0)))
    total = F.sum("a").over(Window.partitionBy("station_id"))  # a target's neighbours
    return scored.select("station_id", "nb_id", (F.col("a") / (total + 1e-8)).alias("w"))


def _softplus(x: float) -> float:
    return math.log1p(math.exp(-abs(x))) + max(x, 0.0)


def latent_kriging(edges: DataFrame, features: list[str], x_layers: list[Layer], y_layers: list[Layer], sigma: float = 0.0, lx: float = 0.0, ly: float = 0.0, tau: float = -3.0) -> DataFrame:
    """station_id, nb_id, w: ordinary kriging in a plane that two frozen models make of the features, the target at its origin.

    A neighbour's coordinates are the two models' normalised relu scores. sigma, lx, ly and tau are raw
    parameters, made positive by softplus; the kernel is sigma^2 exp(-dx^2 / lx^2 - dy^2 / ly^2), with tau^2 on the diagonal.
    """
    s2, wide, high, t2 = _softplus(sigma) ** 2, _softplus(lx) + 1e-6, _softplus(ly) + 1e-6, _softplus(tau) ** 2
    x = score_weight_model(edges, features, x_layers, "relu", inverse=False).withColumnRenamed("w", "x")
    y = score_weight_model(edges, features, y_layers, "relu", inverse=False).withColumnRenamed("w", "y")
    both = x.join(y, ["station_id", "nb_id"])
    g = both.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct("nb_id", "y", "x"))).alias("g"))  # k rows each

    def run(batches):
        for pdf in batches:
            for rows, at in _by_size(pdf):
                at = at / np.array([high, wide])
                n, k = at.shape[:2]
                a = np.ones((n, k + 1, k + 1))
                a[:, :k, :k] = s2 * np.exp(-(_apart(at, at) ** 2)) + t2 * np.eye(k)
                a[:, k, k] = 0.0
                b = np.concatenate([s2 * np.exp(-(at**2).sum(axis=-1)), np.ones((n, 1))], axis=1)
                w = np.linalg.solve(a, b[..., None])[:, :k, 0]
                yield pd.DataFrame({"station_id": np.repeat(rows["station_id"].to_numpy(), k), "nb_id": np.concatenate(list(rows["nb_id"])).astype(np.int64), "w": w.ravel()})

    return g.select("station_id", F.col("g.nb_id").alias("nb_id"), F.col("g.y").alias("dy"), F.col("g.x").alias("dx")).mapInPandas(run, "station_id long, nb_id long, w double")


def kernel_knn(query: DataFrame, ref: DataFrame, k: int, constant: float = 1.0, scales: tuple[float, float] = (1.0, 1.0), exclude_same: bool = False) -> DataFrame:
    """station_id, nb_id, rank, cov: the k points of ref with the largest constant * exp(-r^2 / 2), ties by id.

    r is the distance of places (lat, lon) over the kernel's two lengths, so the search runs on a grid in that space,
    whose cells hold about k points. Very far ones keep their order though their kernel is 0.
    """
    scaled = lambda d: d.select("station_id", (F.col("lat") / scales[0]).alias("lat"), (F.col("lon") / scales[1]).alias("lon"))
    near = knn_ref(scaled(query), scaled(ref), k, exclude_same=exclude_same)
    return near.select("station_id", "nb_id", "rank", (constant * F.exp(-F.col("dist") * F.col("dist") / 2)).alias("cov"))


def nngpr_predict(train: DataFrame, query: DataFrame, k: int, constant: float = 1.0, scales: tuple[float, float] = (1.0, 1.0), alpha: float = 1e-10, normalize: bool = True, exclude_same: bool = False) -> DataFrame:
    """station_id, mean, sd of a Gaussian process given the k training points of largest kernel (`kernel_knn`).

    train: station_id, lat, lon, value; query: station_id, lat, lon. alpha is added to the training
    points' diagonal. normalize: values are standardised by their mean and deviation, and predictions scaled back.
    Systems of a batch are factored together; a query conditions on training points alone.
    """
    stats = train.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")).first()
    mean, sd = (stats["mean"] or 0.0, stats["sd"] or 1.0) if normalize else (0.0, 1.0)
    near = kernel_knn(query, train, k, constant, scales, exclude_same)
    ref = train.select(F.col("station_id").alias("nb_id"), "lat", "lon", "value")
    length = np.array(scales, float)

    def run(batches):
        for pdf in batches:
            for g, at in _by_size(pdf):
                n, k_own = at.shape[:2]
                if not k_own:
                    yield pd.DataFrame({"station_id": g["station_id"], "mean": mean, "sd": sd * math.sqrt(constant)})
                    continue
                at = at / length
                kernel = constant * np.exp(-(_apart(at, at) ** 2) / 2) + alpha * np.eye(k_own)
                c0 = constant * np.exp(-(at**2).sum(axis=-1) / 2)
                lower = np.linalg.cholesky(kernel)
                y = (np.stack(list(g["value"])).astype(float) - mean) / sd
                half = np.linalg.solve(lower, np.stack([c0, y], axis=2))  # one triangular side for both
                m = (half[..., 0] * half[..., 1]).sum(axis=1)
                left = np.maximum(constant - (half[..., 0] ** 2).sum(axis=1), 0.0)
                yield pd.DataFrame({"station_id": g["station_id"], "mean": m * sd + mean, "sd": np.sqrt(left) * sd})

    return _local(query, near, ref).mapInPandas(run, "station_id long, mean double, sd double")


def nngp_weights(neighbors: DataFrame, stations: DataFrame, sigma2: float, tau2: float, ell: float = 1.0, m: int = 10, jitter: float = 1e-8) -> DataFrame:
    """station_id, nb_id, w, variance: ordinary-kriging weights of the m nearest of each target's neighbours.

    Coordinates are taken about all the given neighbours' centroid and over their median distance from it, so that ell,
    the exponential covariance's length, has a scale. The variance is C(0) - w.c + lambda, 1e-12 at least.
    """
    places = stations.select(F.col("station_id").alias("nb_id"), "lat", "lon").withColumn("value", F.lit(0.0))
    own = stations.join(neighbors.select("station_id").distinct(), "station_id", "left_semi")

    def run(batches):
        for pdf in batches:
            for g, at in _by_size(pdf):
                if not at.shape[1]:
                    continue
                radius = np.median(np.linalg.norm(at - at.mean(axis=1, keepdims=True), axis=2), axis=1) + 1e-12
                at = at[:, :m] / radius[:, None, None]  # in order of rank: the nearest
                n, k = at.shape[:2]
                a = np.ones((n, k + 1, k + 1))
                a[:, :k, :k] = sigma2 * np.exp(-_apart(at, at) / ell) + (tau2 + jitter) * np.eye(k)
                a[:, k, k] = 0.0
                c0 = sigma2 * np.exp(-np.linalg.norm(at, axis=2) / ell)
                got = np.linalg.solve(a, np.concatenate([c0, np.ones((n, 1))], axis=1)[..., None])[..., 0]
                w = got[:, :k]
                left = np.maximum(sigma2 + tau2 - (w * c0).sum(axis=1) + got[:, k], 1e-12)
                ids = np.concatenate([x[:k] for x in g["nb_id"]]).astype(np.int64)
                yield pd.DataFrame({"station_id": np.repeat(g["station_id"].to_numpy(), k), "nb_id": ids, "w": w.ravel(), "variance": np.repeat(left, k)})

    return _local(own, neighbors, places).mapInPandas(run, "station_id long, nb_id long, w double, variance double")
