"""Cokriging, external drift, frozen models and kernel neighbours against numpy twins."""

import numpy as np
import pytest

from gaugeloom.operators import drift, learned

POINTS = "station_id long, lat double, lon double, elevation double"


def some(spark, n=12, k=5, steps=40, seed=0):
    rng = np.random.default_rng(seed)
    at, y, d = rng.uniform(-5, 5, size=(n, 2)), rng.normal(size=(n, steps)), rng.normal(size=(n, steps))
    far = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    near = [[int(j) for j in np.argsort(far[i]) if j != i][: k - i % 3] for i in range(n)]
    st = spark.createDataFrame([(i, *map(float, a), 0.0) for i, a in enumerate(at)], POINTS)
    nb = spark.createDataFrame([(i, j, r + 1, float(far[i, j])) for i in range(n) for r, j in enumerate(near[i])], "station_id long, nb_id long, rank int, dist double")
    return st, nb, at, y, d, far, near


def series(spark, x):
    return spark.createDataFrame([(i, p, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for p, v in enumerate(row)], "station_id long, pos int, value double").repartition(3)


def table(df, *cols):
    out = {}
    for r in df.collect():
        out[r.station_id, r.pos] = tuple(r[c] for c in cols)
    return out


def augmented(c, c0, sides, to):
    n, m = len(c), sides.shape[1]
    a = np.zeros((n + m, n + m))
    a[:n, :n], a[:n, n:], a[n:, :n] = c, sides, sides.T
    s = np.linalg.solve(a, np.concatenate([c0, to]))
    return s[:n], s[n:]


@pytest.mark.parametrize("collocated", [True, False])
def test_cokriging(spark, collocated):
    st, nb, at, y, d, far, near = some(spark)
    got = table(drift.cokriging(nb, st, series(spark, y), series(spark, d), nugget1=0.2, nugget2=0.1, collocated=collocated), "out")
    rho = lambda h: np.exp(-3 * (h / 4) ** 2)
    for i, js in enumerate(near):
        second = [*js, i] if collocated else js
        k, m = len(js), len(js) + len(second)
        c = np.zeros((m, m))
        c[:k, :k], c[k:, k:] = 2 * rho(far[np.ix_(js, js)]) + 0.2 * np.eye(k), rho(far[np.ix_(second, second)]) + 0.1 * np.eye(m - k)
        c[:k, k:] = 0.5 * np.sqrt(2) * rho(far[np.ix_(js, second)])
        c[k:, :k] = c[:k, k:].T
        sides = np.zeros((m, 2))
        sides[:k, 0] = sides[k:, 1] = 1
        w, _ = augmented(c, np.concatenate([2 * rho(far[i, js]), 0.5 * np.sqrt(2) * rho(far[i, second])]), sides, np.array([1.0, 0.0]))
        assert np.isclose(w[:k].sum(), 1) and np.isclose(w[k:].sum(), 0)
        assert np.allclose([got[i, t][0] for t in range(40)], w[:k] @ y[js] + w[k:] @ d[second], atol=1e-6)
    with pytest.raises(ValueError):
        drift.cokriging_weights(nb, st, r12=1.5)


def test_ked_interval(spark):
    st, nb, at, y, d, far, near = some(spark)
    got = table(drift.ked_interval(nb, st, series(spark, y), series(spark, d), "spherical", 1.5, 12.0, 0.2, 1e-10), "out", "sd")
    rho = lambda h: np.where(h <= 12, 1 - 1.5 * h / 12 + 0.5 * (h / 12) ** 3, 0)
    for i, js in enumerate(near):
        for t in (0, 7, 39):
            sides, to = np.stack([np.ones(len(js)), d[js, t]], axis=1), np.array([1.0, d[i, t]])
            w, lam = augmented(1.3 * rho(far[np.ix_(js, js)]) + 0.2 * np.eye(len(js)), 1.3 * rho(far[i, js]), sides, to)
            assert np.allclose(got[i, t], (w @ y[js, t], np.sqrt(max(1.3 - w @ (1.3 * rho(far[i, js])) + lam @ to, 0))), atol=1e-5)


def test_ked_fast_is_the_direct_solution(spark):
    """Steps of one mask share a factor; each equals its own solution. Gaps, dry steps and too few neighbours fall back."""
    st, nb, at, y, d, far, near = some(spark, seed=3)
    rng = np.random.default_rng(9)
    y[rng.random(y.shape) < 0.25] = np.nan
    d[:, 5] = 1.0
    y[:, 6] = np.nan
    got = table(drift.ked_fast(nb, st, series(spark, y), series(spark, d)), "out", "fallback")
    seen = set()
    for i, js in enumerate(near):
        spread = np.median([np.nanvar(y[js, t]) if (~np.isnan(y[js, t])).any() else 0 for t in range(40)])
        noise = 0.1 * max(spread, 1e-6)
        for t in range(40):
            on = [j for j in js if not np.isnan(y[j, t])]
            back = len(on) < 2 or np.std(d[on, t]) < 1e-6
            seen.add((back, len(on)))
            assert got[i, t][1] == back
            if not on:
                assert got[i, t][0] is None
            elif back:
                w = 1 / far[i, on]
                assert np.isclose(got[i, t][0], w @ y[on, t] / w.sum())
            else:
                m, s = d[on, t].mean(), d[on, t].std()
                sides = np.stack([np.ones(len(on)), np.clip((d[on, t] - m) / s, -5, 5)], axis=1)
                cov = lambda h: 2 * np.exp(-np.pi / 4 * (h / 4) ** 2)
                w, _ = augmented(cov(far[np.ix_(on, on)]) + noise * np.eye(len(on)), cov(far[i, on]), sides, np.array([1, np.clip((d[i, t] - m) / s, -5, 5)]))
                assert np.isclose(got[i, t][0], w @ y[on, t], atol=1e-5)
    assert {b for b, _ in seen} == {True, False} and {n for _, n in seen} >= {0, 1, 2, 3}


def test_ked_fast_lags_and_smooths_rain(spark):
    st, nb, at, y, d, *_ = some(spark, n=6)
    moved = np.stack([d[:, max(t - 2, 0)] for t in range(40)], axis=1)
    smoothed = np.stack([moved[:, max(0, t - 2) : t + 1].mean(axis=1) for t in range(40)], axis=1)
    first = np.stack([d[:, max(0, t - 2) : t + 1].mean(axis=1) for t in range(40)], axis=1)
    want = np.stack([first[:, max(t - 2, 0)] for t in range(40)], axis=1)
    got = table(drift.ked_fast(nb, st, series(spark, y), series(spark, d), lag=2, smooth=3), "out")
    ref = table(drift.ked_fast(nb, st, series(spark, y), series(spark, want)), "out")
    assert all(np.isclose(got[k][0], ref[k][0]) for k in ref) and not np.allclose(want, smoothed)


NET = [([[0.5, -1.0], [0.25, 2.0]], [0.1, -0.3]), ([[1.5, -0.75]], [0.2])]


def test_score_weight_model(spark):
    edges = spark.createDataFrame([(1, 2, 0.5, 1.0), (1, 3, 2.0, 0.1), (1, 4, None, 1.0), (2, 1, 1e-9, 1.0)], "station_id long, nb_id long, a double, b double")
    for last in ("sigmoid", "relu"):
        got = {(r.station_id, r.nb_id): r.w for r in learned.score_weight_model(edges, ["a", "b"], NET, last).collect()}
        score = {}
        for key, a, b in ((2, 0.5, 1.0), (3, 2.0, 0.1)):
            s = float((np.maximum((1 / (np.array([a, b]) + 1e-6)) @ np.array(NET[0][0]).T + NET[0][1], 0) @ np.array(NET[1][0]).T + NET[1][1])[0])
            score[key] = 1 / (1 + np.exp(-s)) if last == "sigmoid" else max(s, 0)
        for key, s in score.items():
            assert np.isclose(got[1, key], s / (sum(score.values()) + 1e-8))
        assert got[1, 4] == 0.0 and np.isfinite(got[2, 1])
    with pytest.raises(ValueError):
        learned.score_weight_model(edges, ["a", "b"], NET, "tanh")


def test_latent_kriging(spark):
    """A target whose neighbours the models place on one point shares the weights out equally; all weights sum to 1."""
    edges = spark.createDataFrame([(1, j, 1.0, 1.0) for j in (2, 3, 4)] + [(5, j, 0.3 * j, 1.0 / j) for j in (1, 2, 3, 4)], "station_id long, nb_id long, a double, b double")
    w = learned.latent_kriging(edges, ["a", "b"], NET, NET[::1]).toPandas()
    assert np.allclose(w[w.station_id == 1].w, 1 / 3) and np.allclose(w.groupby("station_id").w.sum(), 1)


@pytest.mark.parametrize("normalize", [True, False])
def test_nngpr(spark, normalize):
    rng = np.random.default_rng(4)
    x, y = rng.uniform(-2, 2, size=(30, 2)), rng.normal(2, 3, size=30)
    train = spark.createDataFrame([(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "station_id long, lat double, lon double, value double")
    q = np.array([[0.1, 0.2], [5.0, -9.0], list(x[3])])
    query = spark.createDataFrame([(100 + i, float(a), float(b)) for i, (a, b) in enumerate(q)], "station_id long, lat double, lon double")
    kernel = lambda a, b: 1.5 * np.exp(-(((a[:, None] - b[None]) / [0.5, 2.0]) ** 2).sum(-1) / 2)
    for k in (7, 40):  # more than there are
        got = {r.station_id: r for r in learned.nngpr_predict(train, query, k, 1.5, (0.5, 2.0), 0.01, normalize).collect()}
        m, s = (y.mean(), y.std()) if normalize else (0, 1)
        for i, p in enumerate(q):
            r = (((x - p) / [0.5, 2.0]) ** 2).sum(-1)
            on = np.lexsort((np.arange(30), r))[:k]
            c0 = kernel(p[None], x[on])[0]
            b = np.linalg.solve(kernel(x[on], x[on]) + 0.01 * np.eye(len(on)), c0)
            assert np.isclose(got[100 + i].mean, m + s * (b @ ((y[on] - m) / s))) and np.isclose(got[100 + i].sd, s * np.sqrt(max(1.5 - b @ c0, 0)))


def test_nngp_weights(spark):
    """The m nearest in coordinates about all neighbours' centroid, against the whole system."""
    st, nb, at, _, _, far, near = some(spark, k=6)
    got = {(r.station_id, r.nb_id): r for r in learned.nngp_weights(nb, st, 0.8, 0.2, 1.0, 3).collect()}
    assert len(got) == sum(min(3, len(js)) for js in near)
    for i, js in enumerate(near):
        radius = np.median(np.linalg.norm(at[js] - at[js].mean(axis=0), axis=1))
        on = js[:3]
        h, h0 = far[np.ix_(on, on)] / radius, far[i, on] / radius
        w, lam = augmented(0.8 * np.exp(-h) + (0.2 + 1e-8) * np.eye(3), 0.8 * np.exp(-h0), np.ones((3, 1)), np.ones(1))
        assert np.allclose([got[i, j].w for j in on], w) and np.allclose([got[i, j].variance for j in on], 1.0 - w @ (0.8 * np.exp(-h0)) + lam)
