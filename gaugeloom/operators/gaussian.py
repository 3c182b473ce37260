"""Gaussian processes over nearest neighbours, and least squares.

A point's system holds its k neighbours alone, so it is solved inside a task; between the systems there are
only joins and sums. theta is (sigma2, tau, phi): C(h) = sigma2 * exp(-phi * h), with sigma2 * (1 + tau) on the diagonal.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _local(points: DataFrame, neighbors: DataFrame, ref: DataFrame) -> DataFrame:
    """Each point with arrays of its neighbours in order of rank: nb_id, dy and dx from the point, and ref's value.

    points: station_id, lat, lon; neighbors: station_id, nb_id, rank; ref: nb_id, lat, lon, value. A point without
    neighbours stays, with empty arrays.
    """
    p = points.select("station_id", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    j = neighbors.select("station_id", "nb_id", "rank").join(ref, "nb_id").join(p, "station_id")
    one = F.struct("rank", "nb_id", (F.col("lat") - F.col("t_lat")).alias("dy"), (F.col("lon") - F.col("t_lon")).alias("dx"), "value")
    g = j.groupBy("station_id").agg(F.sort_array(F.collect_list(one)).alias("g"))  # k rows each
    out = points.select("station_id").join(g, "station_id", "left")
    return out.select("station_id", *[F.coalesce(F.col(f"g.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("nb_id", "bigint"), ("dy", "double"), ("dx", "double"), ("value", "double"))])


def _solve(dy, dx, theta) -> tuple[np.ndarray, float]:
    """b = C_nn^-1 c and F = C_00 - c.b."""
    sigma2, tau, phi = theta
    top = sigma2 * (1 + tau)
    if not len(dy):
        return np.zeros(0), top
    y, x = np.asarray(dy, float), np.asarray(dx, float)
    c = sigma2 * np.exp(-phi * np.hypot(y[:, None] - y, x[:, None] - x))
    np.fill_diagonal(c, top)
    c0 = sigma2 * np.exp(-phi * np.hypot(y, x))
    b = np.linalg.solve(c, c0)
    return b, float(top - c0 @ b)


def _places(stations: DataFrame, value: DataFrame | None = None) -> DataFrame:
    s = stations.select(F.col("station_id").alias("nb_id"), "lat", "lon")
    return s.withColumn("value", F.lit(0.0)) if value is None else s.join(value.select(F.col("station_id").alias("nb_id"), "value"), "nb_id")


def vecchia_factors(stations: DataFrame, before: DataFrame, theta: tuple[float, float, float]) -> DataFrame:
    """station_id, nb_id and b (arrays), f: regression of each point on its predecessors, and what variance is left."""

    def run(batches):
        for pdf in batches:
            got = [_solve(y, x, theta) for y, x in zip(pdf["dy"], pdf["dx"])]
            yield pd.DataFrame({"station_id": pdf["station_id"], "nb_id": pdf["nb_id"], "b": [g[0] for g in got], "f": [g[1] for g in got]})

    return _local(stations, before, _places(stations)).select("station_id", "nb_id", "dy", "dx").mapInPandas(run, "station_id long, nb_id array<long>, b array<double>, f double")


def decorrelate(values: DataFrame, factors: DataFrame, *cols: str) -> DataFrame:
    """Each column less its predecessors' share, over sqrt(f)."""
    w = factors.select("station_id", F.explode(F.arrays_zip("nb_id", "b")).alias("e")).select("station_id", "e.nb_id", "e.b")
    known = w.join(values.select(F.col("station_id").alias("nb_id"), *cols), "nb_id")
    less = known.groupBy("station_id").agg(*[F.sum(F.col("b") * F.col(c)).alias(f"__{c}") for c in cols])
    j = values.join(factors.select("station_id", "f"), "station_id").join(less, "station_id", "left")
    return j.select("station_id", *[((F.col(c) - F.coalesce(f"__{c}", F.lit(0.0))) / F.sqrt("f")).alias(c) for c in cols])


def vecchia_loglik(values: DataFrame, factors: DataFrame) -> DataFrame:
    """One row, loss: sum of log f and of the squared decorrelated values (twice the negative log likelihood but for a constant)."""
    d = decorrelate(values, factors, "value").join(factors.select("station_id", "f"), "station_id")
    return d.agg(F.sum(F.log("f") + F.col("value") * F.col("value")).alias("loss"))


def theta_search(values: DataFrame, stations: DataFrame, before: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    """sigma2, tau, phi, loss for each theta of a grid; a batch gives one row of sums a theta, so little is shuffled."""

    def run(batches):
        for pdf in batches:
            for theta in grid:
                loss = 0.0
                for y, x, nb, own in zip(pdf["dy"], pdf["dx"], pdf["value"], pdf["own"]):
                    b, f = _solve(y, x, theta)
                    loss += np.log(f) + (own - float(np.dot(b, nb))) ** 2 / f
                yield pd.DataFrame([(*theta, loss)], columns=["sigma2", "tau", "phi", "loss"])

    has = stations.join(values.select("station_id"), "station_id", "left_semi")
    local = _local(has, before, _places(stations, values)).join(values.select("station_id", F.col("value").alias("own")), "station_id")
    parts = local.select("dy", "dx", "value", "own").mapInPandas(run, "sigma2 double, tau double, phi double, loss double")
    return parts.groupBy("sigma2", "tau", "phi").agg(F.sum("loss").alias("loss"))


def krige_predict_ci(query: DataFrame, neighbors: DataFrame, train: DataFrame, values: DataFrame, theta: tuple[float, float, float], z: float = 1.96) -> DataFrame:
    """station_id, mean, low, high of a process with mean 0, given the neighbours' values; the interval is mean -+ z deviations."""

    def run(batches):
        for pdf in batches:
            got = [_solve(y, x, theta) for y, x in zip(pdf["dy"], pdf["dx"])]
            mean = np.array([float(np.dot(b, v)) for (b, _), v in zip(got, pdf["value"])])
            sd = np.sqrt(np.maximum([f for _, f in got], 0.0))
            yield pd.DataFrame({"station_id": pdf["station_id"], "mean": mean, "low": mean - z * sd, "high": mean + z * sd})

    return _local(query, neighbors, _places(train, values)).select("station_id", "dy", "dx", "value").mapInPandas(run, "station_id long, mean double, low double, high double")


def least_squares(df: DataFrame, target: str, features: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Coefficients, inverse of the Gram matrix, mean squared residual and rows; one aggregate of a few sums reaches the driver."""
    cols = [*features, target]
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    row = df.dropna(subset=cols).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"s{a}_{b}") for a, b in pairs]).first()
    m = np.zeros((len(cols), len(cols)))
    for a, b in pairs:
        m[a, b] = m[b, a] = row[f"s{a}_{b}"] or 0.0
    inverse = np.linalg.pinv(m[:-1, :-1])
    beta = inverse @ m[:-1, -1]
    rest = m[-1, -1] - 2 * beta @ m[:-1, -1] + beta @ m[:-1, :-1] @ beta
    return beta, inverse, max(float(rest), 0.0) / max(row["n"], 1), row["n"]


def linear_gls(values: DataFrame, factors: DataFrame, target: str, features: list[str]) -> DataFrame:
    """feature, coef, variance: least squares of the decorrelated target on the decorrelated columns; features hold their own column of ones."""
    beta, inverse, mse, n = least_squares(decorrelate(values, factors, target, *features), target, features)
    scale = mse * n / max(n - len(features), 1)
    rows = [(f, float(b), float(inverse[i, i] * scale)) for i, (f, b) in enumerate(zip(features, beta))]
    return values.sparkSession.createDataFrame(rows, "feature string, coef double, variance double")


def _linear(features: list[str], beta) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f) * float(b) for f, b in zip(features, beta)])


def coef_interval(df: DataFrame, features: list[str], draws: list[list[float]], q: float = 0.05) -> DataFrame:
    """df with low and high: the q and 1 - q quantiles, interpolated, of the predictions by sampled coefficients (draws: a fixed number)."""
    each = F.sort_array(F.array(*[_linear(features, d) for d in draws]))

    def at(p: float) -> Column:
        place = p * (len(draws) - 1)
        i = min(int(place), len(draws) - 2) if len(draws) > 1 else 0
        return F.col("__p")[i] + (F.col("__p")[min(i + 1, len(draws) - 1)] - F.col("__p")[i]) * (place - i)

    return df.withColumn("__p", each).withColumns({"low": at(q), "high": at(1 - q)}).drop("__p")


def nngp_fit(series: DataFrame, features: list[str]) -> dict:
    """beta by least squares; phi and the variance of what is left by the Gaussian likelihood of the lag-1 residuals, in closed form.

    series: station_id, pos, value and the features (with their column of ones). The likelihood of single series tells
    only the variance, sigma2 + tau2: it is shared out 4 to 1, and the length ell is 1, in normalised coordinates.
    """
    beta, _, _, _ = least_squares(series, "value", features)
    r = series.select("station_id", "pos", (F.col("value") - _linear(features, beta)).alias("r"))
    lagged = r.withColumn("p", F.lag("r").over(Window.partitionBy("station_id").orderBy("pos"))).where("p is not null")
    m = lagged.agg(F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.count(F.lit(1)).alias("n")).first()
    phi = float(np.clip(m["rp"] / m["pp"], -0.999, 0.999)) if m["pp"] else 0.0
    left = ((m["rr"] - 2 * phi * m["rp"] + phi * phi * m["pp"]) / m["n"]) if m["n"] else 0.0
    return {"features": features, "beta": [float(b) for b in beta], "phi": phi, "variance": float(left), "sigma2": 0.8 * float(left), "tau2": 0.2 * float(left), "ell": 1.0}


def nngp_predict(series: DataFrame, weights: DataFrame, fit: dict) -> DataFrame:
    """station_id, pos, out: trend, plus phi times the previous prediction's departure from it, plus the neighbours' weighted innovations.

    series as in nngp_fit; weights: station_id, nb_id, w (`learned.nngp_weights`). A target's own values are not used. The recursion runs along a
    target's steps in one task (a segment's length).
    """
    phi = fit["phi"]
    trend = series.withColumn("trend", _linear(fit["features"], fit["beta"])).withColumn("r", F.col("value") - F.col("trend"))
    before = F.lag("r").over(Window.partitionBy("station_id").orderBy("pos"))
    fresh = trend.select(F.col("station_id").alias("nb_id"), "pos", (F.col("r") - F.coalesce(before, F.lit(0.0)) * phi).alias("e"))
    push = weights.join(fresh, "nb_id").groupBy("station_id", "pos").agg(F.sum(F.col("w") * F.col("e")).alias("u"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out, d = [], 0.0
        for u in pdf["u"].to_numpy(float):
            d = phi * d + u
            out.append(d)
        return pd.DataFrame({"station_id": pdf["station_id"], "pos": pdf["pos"], "out": pdf["trend"].to_numpy(float) + out})

    j = trend.select("station_id", F.col("pos").cast("long").alias("pos"), "trend").join(push.withColumn("pos", F.col("pos").cast("long")), ["station_id", "pos"])
    return j.groupBy("station_id").applyInPandas(run, "station_id long, pos long, out double")


def rain_response(df: DataFrame, target: str, rain: str, lags: int = 24) -> DataFrame:
    """lag, coef: linear response of the target to the last `lags` values of rain (lag 0 is the same step), after a constant (lag -1)."""
    w = Window.partitionBy("station_id").orderBy("pos")
    wide = df.select(F.col(target).alias("y"), F.lit(1.0).alias("c"), *[F.lag(rain, k).over(w).alias(f"x{k}") for k in range(lags)])
    beta, _, _, _ = least_squares(wide, "y", ["c", *[f"x{k}" for k in range(lags)]])
    return df.sparkSession.createDataFrame([(k - 1, float(b)) for k, b in enumerate(beta)], "lag int, coef double")


def oracle_weights(neighbors: DataFrame, series: DataFrame, ridge: float = 1e-6, steps: int = 2000) -> DataFrame:
    """station_id, nb_id, w: the best fixed weights on the simplex for each target's own series.

    The Gram matrices are sums over the steps; only k * k numbers a target reach the solver (accelerated projected gradient).
    """
    x = series.select(F.col("station_id").alias("nb_id"), "pos", "value")
    v = neighbors.select("station_id", "nb_id").join(x, "nb_id").groupBy("station_id", "pos").agg(F.sort_array(F.collect_list(F.struct("nb_id", "value"))).alias("g"))
    v = v.join(series.withColumnRenamed("value", "tgt"), ["station_id", "pos"])
    one = v.select("station_id", "g", F.posexplode("g").alias("i", "a"), "tgt")
    two = one.select("station_id", F.col("a.nb_id").alias("nb_id"), (F.col("a.value") * F.col("tgt")).alias("b"), F.col("a.value").alias("av"), F.posexplode("g").alias("j", "c"))
    gram = two.groupBy("station_id", "nb_id", F.col("c.nb_id").alias("nb2")).agg(F.sum(F.col("av") * F.col("c.value")).alias("a"), F.sum("b").alias("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot(index="nb_id", columns="nb2", values="a").fillna(0.0)
        m, b = a.to_numpy() + ridge * np.eye(len(a)), pdf.groupby("nb_id")["b"].first().reindex(a.index).to_numpy()
        size = np.linalg.eigvalsh(m)[-1]
        w = y = np.full(len(b), 1 / len(b))
        t = 1.0
        for _ in range(steps):
            new = _simplex(y - (m @ y - b) / size)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, moved = new + (t - 1) / t2 * (new - w), np.abs(new - w).max()
            w, t = new, t2
            if moved < 1e-12:
                break
        return pd.DataFrame({"station_id": pdf["station_id"].iloc[0], "nb_id": a.index, "w": w})

    return gram.groupBy("station_id").applyInPandas(run, "station_id long, nb_id long, w double")


def _simplex(v: np.ndarray) -> np.ndarray:
    s = np.sort(v)[::-1]
    c = (np.cumsum(s) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.nonzero(s > c)[0][-1]], 0.0)
