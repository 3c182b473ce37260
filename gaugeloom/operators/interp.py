"""Spatial interpolation: weights depend on geometry, so they are a table, applied to all steps by one join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import correlation


def idw_weights(neighbors: DataFrame, power: float = 2.0, floor: float = 1e-12, eps: float = 1e-12) -> DataFrame:
    """station_id, nb_id, w = d ** -power over its sum."""
    a = F.pow(F.greatest(F.col("dist"), F.lit(floor)), F.lit(-power))
    return neighbors.withColumn("a", a).withColumn("w", F.col("a") / (F.sum("a").over(Window.partitionBy("station_id")) + eps)).select("station_id", "nb_id", "w")


def idw_river(neighbors: DataFrame) -> DataFrame:
    """Weights by river distance: a negative one (no path) counts as 9999, zero as 1e-12."""
    d = F.when(F.col("dist") < 0, 9999.0).otherwise(F.greatest(F.col("dist"), F.lit(1e-12)))
    return neighbors.withColumn("a", 1 / d).withColumn("w", F.col("a") / (F.sum("a").over(Window.partitionBy("station_id")) + 1e-8)).select("station_id", "nb_id", "w")


def weights_apply(weights: DataFrame, series: DataFrame) -> DataFrame:
    """station_id, pos, out: sum of the neighbours' weighted values."""
    s = series.withColumnRenamed("station_id", "nb_id")
    return weights.join(s, "nb_id").groupBy("station_id", "pos").agg(F.sum(F.col("w") * F.col("value")).alias("out"))


def score(out: DataFrame, series: DataFrame, method: str) -> DataFrame:
    """Predictions beside the truth."""
    return out.join(series.withColumnRenamed("value", "tgt"), ["station_id", "pos"]).select(F.lit(method).alias("method"), "station_id", F.col("pos").cast("long").alias("pos"), "tgt", "out")


def pair_covariance(pairs: DataFrame, sill: float, nugget: float, reach: float, kind: str = "exponential") -> DataFrame:
    """Covariance of pairs (a, b, dist); the nugget counts where a is b."""
    return pairs.withColumn("cov", sill * correlation(kind, F.col("dist"), reach) + F.when(F.col("a") == F.col("b"), nugget).otherwise(0.0))


def _geometry(neighbors: DataFrame, stations: DataFrame) -> DataFrame:
    t = stations.select("station_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col("elevation").alias("t_z"))
    n = stations.select(F.col("station_id").alias("nb_id"), "lat", "lon", F.col("elevation").alias("z"))
    return neighbors.join(t, "station_id").join(n, "nb_id").select("station_id", "nb_id", "rank", (F.col("lat") - F.col("t_lat")).alias("dy"), (F.col("lon") - F.col("t_lon")).alias("dx"), "z", "t_z")


def _rho(h: np.ndarray, kind: str, reach: float) -> np.ndarray:
    u = h / reach
    if kind == "gaussian":
        return np.exp(-3 * u * u)
    if kind == "exponential":
        return np.exp(-3 * u)
    return np.where(u <= 1, 1 - 1.5 * u + 0.5 * u**3, 0.0)


def kriging_system(c: np.ndarray, c0: np.ndarray, drift: np.ndarray, drift0: np.ndarray) -> np.ndarray:
    """Weights with sum(w * drift) = drift0 for each drift column."""
    k, p = drift.shape
    a = np.zeros((k + p, k + p))
    a[:k, :k], a[:k, k:], a[k:, :k] = c, drift, drift.T
    return np.linalg.solve(a, np.concatenate([c0, drift0]))[:k]


def _weights(neighbors: DataFrame, stations: DataFrame, solve) -> DataFrame:
    """Weights of each target's neighbours; where the system is singular, by inverse distance (fallback)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        xy = pdf[["dx", "dy"]].to_numpy(float)
        try:
            w, back = solve(xy, pdf["z"].to_numpy(float), float(pdf["t_z"].iloc[0])), False
            if not np.isfinite(w).all():
                raise np.linalg.LinAlgError
        except np.linalg.LinAlgError:
            a = 1 / np.maximum(np.hypot(xy[:, 0], xy[:, 1]), 1e-12) ** 2
            w, back = a / a.sum(), True
        return pd.DataFrame({"station_id": pdf["station_id"], "nb_id": pdf["nb_id"], "w": w, "fallback": back})

    return _geometry(neighbors, stations).groupBy("station_id").applyInPandas(run, "station_id long, nb_id long, w double, fallback boolean")


def ordinary_kriging(neighbors: DataFrame, stations: DataFrame, kind: str = "exponential", sill: float = 1.0, reach: float = 4.0, nugget: float = 1e-6) -> DataFrame:
    def solve(xy, z, z0):
        h = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        one = np.ones((len(xy), 1))
        return kriging_system(sill * _rho(h, kind, reach) + nugget * np.eye(len(xy)), sill * _rho(np.hypot(xy[:, 0], xy[:, 1]), kind, reach), one, np.ones(1))

    return _weights(neighbors, stations, solve)


def ked(neighbors: DataFrame, stations: DataFrame, kind: str = "exponential", sill: float = 1.0, reach: float = 4.0, nugget: float = 1e-6) -> DataFrame:
    """Kriging with elevation as external drift."""

    def solve(xy, z, z0):
        h = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        if np.ptp(z) < 1e-9:
            raise np.linalg.LinAlgError
        scale = z.std() or 1.0
        drift = np.stack([np.ones(len(xy)), (z - z.mean()) / scale], axis=1)
        return kriging_system(sill * _rho(h, kind, reach) + nugget * np.eye(len(xy)), sill * _rho(np.hypot(xy[:, 0], xy[:, 1]), kind, reach), drift, np.array([1.0, (z0 - z.mean()) / scale]))

    return _weights(neighbors, stations, solve)


def rbf_thin_plate(neighbors: DataFrame, stations: DataFrame) -> DataFrame:
    def solve(xy, z, z0):
        if len(xy) == 1:
            return np.ones(1)
        phi = lambda r: np.where(r > 0, r * r * np.log(np.maximum(r, 1e-300)), 0.0)
        h = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
        return kriging_system(phi(h), phi(np.hypot(xy[:, 0], xy[:, 1])), np.concatenate([np.ones((len(xy), 1)), xy], axis=1), np.array([1.0, 0.0, 0.0]))

    return _weights(neighbors, stations, solve)


METHODS = {"ordinary_kriging": ordinary_kriging, "ked": ked, "rbf_thin_plate": rbf_thin_plate, "idw": lambda nb, st, **o: idw_weights(nb, **o)}


def register_method(name: str, weights) -> None:
    """Add a method: weights(neighbors, stations, **params) gives (station_id, nb_id, w)."""
    METHODS[name] = weights


def interpolate(neighbors: DataFrame, stations: DataFrame, series: DataFrame, method: str, **params) -> DataFrame:
    return weights_apply(METHODS[method](neighbors, stations, **params).select("station_id", "nb_id", "w"), series)


def normalize_coords(geometry: DataFrame) -> DataFrame:
    """Coordinates about the neighbours' centroid, over their median radius (station_id, nb_id, x, y)."""
    w = geometry.groupBy("station_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = geometry.join(w, "station_id").select("station_id", "nb_id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    r = c.groupBy("station_id").agg(F.median(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("r"))
    return c.join(r, "station_id").select("station_id", "nb_id", F.try_divide("x", "r").alias("x"), F.try_divide("y", "r").alias("y"))


def sparsemax(scores: DataFrame) -> DataFrame:
    """Projection of each group's scores (station_id, nb_id, s) onto the simplex."""
    w = Window.partitionBy("station_id").orderBy(F.col("s").desc(), "nb_id")
    r = scores.withColumns({"k": F.row_number().over(w), "c": F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    tau = r.where(1 + F.col("k") * F.col("s") > F.col("c")).groupBy("station_id").agg(F.max_by((F.col("c") - 1) / F.col("k"), "k").alias("tau"))
    return scores.join(tau, "station_id").select("station_id", "nb_id", F.greatest(F.col("s") - F.col("tau"), F.lit(0.0)).alias("p"))


def consensus(series: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Mean absolute correlation of a station's series with its neighbours'."""
    a = series.withColumnRenamed("value", "x")
    b = series.withColumnsRenamed({"station_id": "nb_id", "value": "y"})
    c = neighbors.select("station_id", "nb_id").join(a, "station_id").join(b, ["nb_id", "pos"]).groupBy("station_id", "nb_id").agg(F.corr("x", "y").alias("c"))
    return c.groupBy("station_id").agg(F.avg(F.abs("c")).alias("consensus"))


def residual_correct(pred: DataFrame, weights: DataFrame) -> DataFrame:
    """Prediction plus the weighted residuals of the neighbours' own predictions (station_id, pos, tgt, out)."""
    r = pred.select(F.col("station_id").alias("nb_id"), "pos", (F.col("tgt") - F.col("out")).alias("res"))
    add = weights.join(r, "nb_id").groupBy("station_id", "pos").agg(F.sum(F.col("w") * F.col("res")).alias("more"))
    return pred.join(add, ["station_id", "pos"], "left").select("station_id", "pos", (F.col("out") + F.coalesce("more", F.lit(0.0))).alias("out"))


def coord_basis(stations: DataFrame, counts: tuple[int, ...] = (4, 16)) -> DataFrame:
    """Wendland basis of min-max scaled coordinates on knot grids: station_id, knot, value (only non-zero ones)."""
    e = stations.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"))
    s = stations.join(F.broadcast(e)).select("station_id", ((F.col("lat") - F.col("a")) / (F.col("b") - F.col("a"))).alias("y"), ((F.col("lon") - F.col("c")) / (F.col("d") - F.col("c"))).alias("x"))  # e: one row
    knots = []
    for n in counts:
        side = round(n**0.5)
        knots += [(f"{n}:{i}:{j}", i / (side - 1), j / (side - 1), 2.5 / side) for i in range(side) for j in range(side)]
    k = F.explode(F.array(*[F.struct(F.lit(a).alias("knot"), F.lit(b).alias("kx"), F.lit(c).alias("ky"), F.lit(t).alias("theta")) for a, b, c, t in knots]))
    g = s.withColumn("k", k).select("station_id", "k.knot", (F.sqrt(F.pow(F.col("x") - F.col("k.kx"), 2) + F.pow(F.col("y") - F.col("k.ky"), 2)) / F.col("k.theta")).alias("d"))
    return g.where("d <= 1").select("station_id", "knot", (F.pow(1 - F.col("d"), 6) * (35 * F.col("d") * F.col("d") + 18 * F.col("d") + 3) / 3).alias("value"))


def linear_variogram_kriging(neighbors: DataFrame, stations: DataFrame, series: DataFrame, drift: bool = False, bins: int = 6) -> DataFrame:
    """station_id, nb_id, w, fallback: kriging by a linear variogram fitted to each target's neighbours.

    Semivariances of the neighbours' series are averaged over the steps and then in `bins` equal ranges of distance; a
    line with a slope and a nugget of at least 0 is fitted through the means, weighted by their pairs. drift adds the
    elevation (universal kriging). Where the system is singular, weights are by inverse distance.
    """
    v = neighbors.select("station_id", "nb_id").join(series.withColumnRenamed("station_id", "nb_id"), "nb_id")
    a, b = v.withColumnsRenamed({"nb_id": "na", "value": "va"}), v.withColumnsRenamed({"nb_id": "nb", "value": "vb"})
    pair = a.join(b, ["station_id", "pos"]).where("na < nb").groupBy("station_id", "na", "nb").agg((F.avg(F.pow(F.col("va") - F.col("vb"), 2)) / 2).alias("g"))
    semi = pair.groupBy("station_id").agg(F.collect_list(F.struct("na", "nb", "g")).alias("semi"))  # k * (k - 1) / 2 entries

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        xy, z, z0 = pdf[["dx", "dy"]].to_numpy(float), pdf["z"].to_numpy(float), float(pdf["t_z"].iloc[0])
        try:
            w, back = _linear_weights(xy, z, z0, list(pdf["nb_id"]), pdf["semi"].iloc[0], drift, bins), False
        except np.linalg.LinAlgError:
            d = 1 / np.maximum(np.hypot(xy[:, 0], xy[:, 1]), 1e-12) ** 2
            w, back = d / d.sum(), True
        return pd.DataFrame({"station_id": pdf["station_id"], "nb_id": pdf["nb_id"], "w": w, "fallback": back})

    g = _geometry(neighbors, stations).join(semi, "station_id", "left")
    return g.groupBy("station_id").applyInPandas(run, "station_id long, nb_id long, w double, fallback boolean")


def _linear_weights(xy: np.ndarray, z: np.ndarray, z0: float, ids: list, semi, drift: bool, bins: int) -> np.ndarray:
    h = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1))
    at = {n: i for i, n in enumerate(ids)}
    found = np.array([(h[at[e["na"]], at[e["nb"]]], e["g"]) for e in semi if e["g"] is not None], float) if semi is not None else np.zeros((0, 2))
    if len(found) < 2:
        raise np.linalg.LinAlgError
    edges = np.linspace(found[:, 0].min(), found[:, 0].max(), bins + 1)
    place = np.clip(np.searchsorted(edges, found[:, 0], side="right") - 1, 0, bins - 1)
    n = np.bincount(place, minlength=bins)
    use = n > 0
    mean = lambda x: np.bincount(place, x, minlength=bins)[use] / n[use]
    d, g, n = mean(found[:, 0]), mean(found[:, 1]), n[use]
    spread = (n * (d - np.average(d, weights=n)) ** 2).sum()
    slope = max((n * (d - np.average(d, weights=n)) * g).sum() / spread, 0.0) if spread > 0 else 0.0
    nugget = max(np.average(g, weights=n) - slope * np.average(d, weights=n), 0.0)
    if slope == 0 and nugget > 0:
        slope, nugget = 1e-9 * nugget, nugget
    gamma = slope * h + nugget * (1 - np.eye(len(h)))
    cols = [np.ones(len(z))]
    own = [1.0]
    if drift:
        if np.ptp(z) < 1e-9:
            raise np.linalg.LinAlgError
        cols.append((z - z.mean()) / z.std())
        own.append((z0 - z.mean()) / z.std())
    w = kriging_system(gamma, slope * np.hypot(xy[:, 0], xy[:, 1]) + nugget, np.stack(cols, axis=1), np.array(own))
    if not np.isfinite(w).all():
        raise np.linalg.LinAlgError
    return w
