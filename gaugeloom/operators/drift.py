"""Kriging with a second variable: cokriging, and rain as an external drift that changes with each step.

A target's system depends on its neighbours' places, so it is factored once and used for all steps; series travel
as one array a station. levels and rain: station_id, pos, value, with the same steps for all stations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gaussian import _local, _places


def station_arrays(series: DataFrame) -> DataFrame:
    """station_id and values, in the order of pos; nulls stay."""
    g = series.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("g"))  # a segment's steps
    return g.select("station_id", F.transform("g", lambda x: x["value"]).alias("values"))


def weighted_arrays(parts: DataFrame) -> DataFrame:
    """station_id, values: sums of w times values, step by step, over the rows (station_id, w, values) of a target."""
    g = parts.groupBy("station_id").agg(F.collect_list(F.struct("w", "values")).alias("g"))  # a row for each neighbour
    zero = F.transform(F.col("g")[0]["values"], lambda _: F.lit(0.0))
    return g.select("station_id", F.aggregate("g", zero, lambda a, x: F.zip_with(a, x["values"], lambda s, v: s + x["w"] * v)).alias("values"))


def covariance(kind: str, h: np.ndarray, reach: float) -> np.ndarray:
    """Correlation at distance h; gaussian_length takes the integral scale as its reach, the others the practical range."""
    u = h / max(reach, 1e-12)
    if kind == "gaussian":
        return np.exp(-3 * u * u)
    if kind == "gaussian_length":
        return np.exp(-np.pi / 4 * u * u)
    if kind == "exponential":
        return np.exp(-3 * u)
    if kind == "spherical":
        return np.where(u <= 1, 1 - 1.5 * u + 0.5 * u**3, 0.0)
    raise ValueError(f"unknown correlation {kind}")


def _targets(neighbors: DataFrame, stations: DataFrame) -> DataFrame:
    """station_id with arrays nb_id, dy, dx of its neighbours by rank."""
    own = stations.join(neighbors.select("station_id").distinct(), "station_id", "left_semi")
    return _local(own, neighbors, _places(stations)).select("station_id", "nb_id", "dy", "dx").where(F.size("nb_id") > 0)


def _by_size(pdf: pd.DataFrame):
    """Rows of a batch by their number of neighbours, with places as (rows, k, 2): systems of one size are solved together."""
    for _, g in pdf.groupby(pdf["nb_id"].map(len)):
        yield g, np.stack([np.stack([np.asarray(y, float), np.asarray(x, float)], axis=1) for y, x in zip(g["dy"], g["dx"])])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, :, None] - b[:, None]) ** 2).sum(axis=-1))


def cokriging_weights(neighbors: DataFrame, stations: DataFrame, kind: str = "gaussian", reach: float = 4.0, sill1: float = 2.0, sill2: float = 1.0, r12: float = 0.5, nugget1: float = 0.0, nugget2: float = 0.0, eps: float = 1e-10, collocated: bool = True) -> DataFrame:
    """station_id, nb_id, w1, w2: weights of the neighbours' levels (sum 1) and of rain (sum 0).

    One correlation serves both variables and their cross-covariance r12 * sqrt(sill1 * sill2). collocated:
    the target's own rain counts too, in a row whose nb_id is the target, with w1 = 0.
    """
    if not -1 <= r12 <= 1:
        raise ValueError("r12 must lie from -1 to 1")
    cross = r12 * np.sqrt(sill1 * sill2)

    def run(batches):
        for pdf in batches:
            for g, at in _by_size(pdf):
                n, k = at.shape[:2]
                second = np.concatenate([at, np.zeros((n, 1, 2))], axis=1) if collocated else at
                m = k + second.shape[1]
                c = np.empty((n, m, m))
                c[:, :k, :k] = sill1 * covariance(kind, _apart(at, at), reach) + nugget1 * np.eye(k)
                c[:, k:, k:] = sill2 * covariance(kind, _apart(second, second), reach) + nugget2 * np.eye(m - k)
                c[:, :k, k:] = cross * covariance(kind, _apart(at, second), reach)
                c[:, k:, :k] = c[:, :k, k:].transpose(0, 2, 1)
                c += eps * np.eye(m)
                c0 = np.concatenate([sill1 * covariance(kind, np.hypot(at[..., 0], at[..., 1]), reach), cross * covariance(kind, np.hypot(second[..., 0], second[..., 1]), reach)], axis=1)
                sides = np.zeros((m, 2))
                sides[:k, 0] = sides[k:, 1] = 1.0
                got = np.linalg.solve(c, np.concatenate([np.broadcast_to(sides, (n, m, 2)), c0[..., None]], axis=2))
                schur = sides.T @ got[..., :2] + eps * np.eye(2)
                lam = np.linalg.solve(schur, (sides.T @ got[..., 2:]) - np.array([[1.0], [0.0]]))
                w = (got[..., 2:] - got[..., :2] @ lam)[..., 0]
                pad = np.zeros((n, m - 2 * k))
                w1, w2 = np.concatenate([w[:, :k], pad], axis=1), w[:, k:]
                ids = [[*nb, own][: m - k] for nb, own in zip(g["nb_id"], g["station_id"])]
                yield pd.DataFrame({"station_id": np.repeat(g["station_id"].to_numpy(), m - k), "nb_id": np.concatenate(ids).astype(np.int64), "w1": w1.ravel(), "w2": w2.ravel()})

    return _targets(neighbors, stations).mapInPandas(run, "station_id long, nb_id long, w1 double, w2 double")


def cokriging(neighbors: DataFrame, stations: DataFrame, levels: DataFrame, rain: DataFrame, **params) -> DataFrame:
    """station_id, pos, out: levels at each target from the neighbours' levels and rain; params as in `cokriging_weights`."""
    w = cokriging_weights(neighbors, stations, **params)
    as_nb = lambda s: station_arrays(s).withColumnRenamed("station_id", "nb_id")
    parts = w.where("w1 <> 0").select("station_id", "nb_id", F.col("w1").alias("w")).join(as_nb(levels), "nb_id").select("station_id", "w", "values")
    parts = parts.unionByName(w.select("station_id", "nb_id", F.col("w2").alias("w")).join(as_nb(rain), "nb_id").select("station_id", "w", "values"))
    return weighted_arrays(parts).select("station_id", F.posexplode("values").alias("pos", "out"))


def _with_series(neighbors: DataFrame, stations: DataFrame, levels: DataFrame, rain: DataFrame) -> DataFrame:
    """station_id; places dy, dx, levels y and rain d of its neighbours by rank; its own rain d0."""
    c = F.col
    place = stations.select("station_id", c("lat").alias("t_lat"), c("lon").alias("t_lon"))
    y = station_arrays(levels).select(c("station_id").alias("nb_id"), c("values").alias("y"))
    d = station_arrays(rain).select(c("station_id").alias("nb_id"), c("values").alias("d"))
    near = neighbors.select("station_id", "nb_id", "rank").join(_places(stations).drop("value"), "nb_id").join(place, "station_id").join(y, "nb_id").join(d, "nb_id")
    one = F.struct("rank", "nb_id", (c("lat") - c("t_lat")).alias("dy"), (c("lon") - c("t_lon")).alias("dx"), "y", "d")
    g = near.groupBy("station_id").agg(F.sort_array(F.collect_list(one)).alias("g"))  # k arrays of a segment's steps
    own = d.select(c("nb_id").alias("station_id"), c("d").alias("d0"))
    return g.join(own, "station_id").select("station_id", *[F.col(f"g.{x}").alias(x) for x in ("dy", "dx", "y", "d")], "d0")


def _drift_step(c: np.ndarray, c0: np.ndarray, y: np.ndarray, d: np.ndarray, d0: np.ndarray, ridge: float = 0.0) -> tuple[np.ndarray, ...]:
    """Predictions of all steps (columns) with weights that sum to 1 and carry d to d0, from one factor of c.

    Gives the predictions, the determinants, the weights' sums with c0, and both multipliers: the drift's 2 x 2 system is
    solved in closed form for each step.
    """
    got = np.linalg.solve(c, np.concatenate([np.ones((len(c), 1)), c0[:, None], d], axis=1))
    a, b, e = got[:, 0], got[:, 1], got[:, 2:]
    s11, s12, s22 = a.sum() + ridge, e.sum(axis=0), (d * e).sum(axis=0) + ridge
    r1, r2 = b.sum() - 1.0, d.T @ b - d0
    det = s11 * s22 - s12 * s12
    with np.errstate(divide="ignore", invalid="ignore"):
        mu, lam = (r1 * s22 - r2 * s12) / det, (r2 * s11 - r1 * s12) / det
        out = b @ y - mu * (a @ y) - lam * (e * y).sum(axis=0)
        with_c0 = b @ c0 - mu * (a @ c0) - lam * (e.T @ c0)
    return out, det, with_c0, mu, lam


def ked_interval(neighbors: DataFrame, stations: DataFrame, levels: DataFrame, rain: DataFrame, kind: str = "spherical", sill: float = 1.0, reach: float = 10.0, nugget: float = 0.0, eps: float = 1e-8) -> DataFrame:
    """station_id, pos, out, sd: kriging with each step's rain as external drift, and its deviation.

    The nugget is on the diagonal alone; the variance is C(0) - w.c + lambda.f0, 0 at least, C(0) without nugget. Rain that
    is equal at all neighbours leaves the drift to the ridge eps.
    """

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                at = np.stack([r.dy, r.dx], axis=1)
                y, d, d0 = (np.stack(x).astype(float) if x is not r.d0 else np.asarray(x, float) for x in (r.y, r.d, r.d0))
                h = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
                c = (sill - nugget) * covariance(kind, h, reach) + (nugget + eps) * np.eye(len(at))
                c0 = (sill - nugget) * covariance(kind, np.hypot(at[:, 0], at[:, 1]), reach)
                out, _, with_c0, mu, lam = _drift_step(c, c0, y, d, d0, eps)
                sd = np.sqrt(np.maximum(sill - nugget - with_c0 + mu + lam * d0, 0.0))
                yield pd.DataFrame({"station_id": r.station_id, "pos": np.arange(len(d0)), "out": out, "sd": sd})

    return _with_series(neighbors, stations, levels, rain).mapInPandas(run, "station_id long, pos int, out double, sd double")


def _trailing(x: np.ndarray, width: int) -> np.ndarray:
    """Means of the last `width` values, fewer at the beginning."""
    if width <= 1:
        return x
    sums = np.cumsum(np.concatenate([np.zeros((*x.shape[:-1], 1)), x], axis=-1), axis=-1)
    at = np.arange(1, x.shape[-1] + 1)
    begin = np.maximum(at - width, 0)
    return (sums[..., at] - sums[..., begin]) / (at - begin)


def ked_fast(
    neighbors: DataFrame, stations: DataFrame, levels: DataFrame, rain: DataFrame, kind: str = "gaussian_length", variance: float = 2.0, reach: float = 4.0, noise: float | None = None, share: float = 0.1,
    eps: float = 1e-10, standard: bool = True, clamp: float = 5.0, floor: float = 1e-6, lag: int = 0, smooth: int = 0, power: float = 1.0,
) -> DataFrame:
    """station_id, pos, out, fallback: kriging with each step's rain as drift, one factor for each set of valid neighbours.

    A neighbour is valid at a step where its level isn't null; steps with the same valid ones are solved together. noise is
    added to the diagonal: None takes `share` of the median, over the steps, of the variance among neighbours.
    standard: rain is scored by the valid neighbours' mean and deviation, and clamped. lag and smooth: rain of
    `lag` steps before, as a mean over `smooth` steps. By inverse distance (fallback) where rain deviates
    by less than floor, the determinant is below eps, or fewer than two neighbours are valid.
    """

    def one(r) -> pd.DataFrame:
        at = np.stack([r.dy, r.dx], axis=1)
        y, d, d0 = np.stack(r.y).astype(float), _trailing(np.stack(r.d).astype(float), smooth), _trailing(np.asarray(r.d0, float), smooth)
        if lag:
            back = np.maximum(np.arange(y.shape[1]) - lag, 0)
            d, d0 = d[:, back], d0[back]
        valid = ~np.isnan(y)
        far = np.maximum(np.hypot(at[:, 0], at[:, 1]), 1e-12)
        some = valid.sum(axis=0)
        seen = np.where(valid, y, 0.0)
        mean = seen.sum(axis=0) / np.maximum(some, 1)
        spread = (np.where(valid, y - mean, 0.0) ** 2).sum(axis=0) / np.maximum(some, 1)
        extra = noise if noise is not None else share * max(float(np.median(spread)), 1e-6)
        near = valid / far[:, None] ** power
        out = (near * seen).sum(axis=0) / (near.sum(axis=0) + 1e-12)
        out[some == 0] = np.nan
        back = np.ones(y.shape[1], bool)
        h = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
        masks, which = np.unique(valid, axis=1, return_inverse=True)
        for i, mask in enumerate(masks.T):
            steps = np.flatnonzero(which.ravel() == i)
            if mask.sum() < 2:
                continue
            dn, dt = d[np.ix_(mask, steps)], d0[steps]
            deviation = dn.std(axis=0)
            if standard:
                m = dn.mean(axis=0)
                dn, dt = np.clip((dn - m) / (deviation + 1e-12), -clamp, clamp), np.clip((dt - m) / (deviation + 1e-12), -clamp, clamp)
            c = variance * covariance(kind, h[np.ix_(mask, mask)], reach) + (extra + eps) * np.eye(mask.sum())
            c0 = variance * covariance(kind, far[mask], reach)
            got, det, _, _, _ = _drift_step(c, c0, y[np.ix_(mask, steps)], dn, dt)
            good = (deviation >= floor) & (np.abs(det) >= eps)
            out[steps[good]], back[steps[good]] = got[good], False
        return pd.DataFrame({"station_id": r.station_id, "pos": np.arange(len(out)), "out": out, "fallback": back})

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                yield one(r)

    return _with_series(neighbors, stations, levels, rain).mapInPandas(run, "station_id long, pos int, out double, fallback boolean").withColumn("out", F.when(~F.isnan("out"), F.col("out")))
