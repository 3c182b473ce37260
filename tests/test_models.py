"""Operators of plans/models.py that SQL can't say, against numpy; test_queries.py compares the others."""

import itertools

import numpy as np

from gaugeloom.operators import evaluate, gaussian, interp, paths

POINTS = "station_id long, lat double, lon double, elevation double"


def _some(spark, n=12, k=4, steps=30):
    rng = np.random.default_rng(5)
    at = rng.normal(size=(n, 3))
    x = rng.normal(size=(n, steps)).cumsum(axis=1)
    st = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(at)], POINTS)
    d = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    near = [[int(j) for j in np.argsort(d[i]) if j != i][:k] for i in range(n)]
    nb = spark.createDataFrame([(i, j, r + 1, float(d[i, j])) for i in range(n) for r, j in enumerate(near[i])], "station_id long, nb_id long, rank int, dist double")
    series = spark.createDataFrame([(i, p, float(x[i, p])) for i in range(n) for p in range(steps)], "station_id long, pos int, value double")
    return st, nb, series, at, x, near


def test_oracle_weights(spark):
    """No vector of a grid over the simplex does better, nor does any single neighbour."""
    _, nb, series, _, x, near = _some(spark, 6, 3)
    got = {(r.station_id, r.nb_id): r.w for r in gaussian.oracle_weights(nb, series).collect()}
    grid = [w for w in itertools.product(np.linspace(0, 1, 21), repeat=3) if abs(sum(w) - 1) < 1e-9]
    for i, js in enumerate(near):
        w = np.array([got[i, j] for j in js])
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0
        loss = lambda v: ((x[i] - np.array(v) @ x[js]) ** 2).sum()
        assert loss(w) <= min(map(loss, grid)) + 1e-3


def test_linear_variogram_kriging(spark):
    st, nb, series, at, x, near = _some(spark)
    for drift in (False, True):
        w = interp.linear_variogram_kriging(nb, st, series, drift).toPandas()
        assert np.allclose(w.groupby("station_id").w.sum(), 1)
        if drift:
            for i, g in w[~w.fallback].groupby("station_id"):
                assert np.isclose((g.w * at[g.nb_id, 2]).sum(), at[i, 2])


def test_linear_weights_by_hand(spark):
    """Two neighbours, as far from each other as 2, at distances 0.5 and 1.5: gamma is a line, so weights are 3/4 and 1/4."""
    semi = [{"na": 1, "nb": 2, "g": 1.0}, {"na": 2, "nb": 1, "g": 1.0}]
    xy = np.array([[-0.5, 0.0], [1.5, 0.0]])
    w = interp._linear_weights(xy, np.zeros(2), 0.0, [1, 2], [*semi, {"na": 1, "nb": 1, "g": 0.0}], False, 6)
    assert np.allclose(w, [0.75, 0.25])


def test_rain_response(spark):
    rng = np.random.default_rng(2)
    rain = rng.normal(size=200)
    rows = [(1, t, float(rain[t]), float(0.5 + 2 * rain[t] - rain[t - 2])) for t in range(2, 200)]
    df = spark.createDataFrame(rows, "station_id long, pos int, rain double, water double")
    got = {r.lag: r.coef for r in gaussian.rain_response(df, "water", "rain", 3).collect()}
    assert np.allclose([got[k] for k in (-1, 0, 1, 2)], [0.5, 2, 0, -1], atol=1e-9)


def test_find_peaks(spark):
    """Flat tops count once, in the middle; near peaks yield to higher ones; small dips have no prominence."""
    x = [0, 0.7, 0.65, 0.8, 0.1, 0.1, 0.9, 0.9, 0.9, 0.2, 0.5, 0.2, 0.2, 1.0, 0.95, 0.96, 0.3, 0.8]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)] + [(2, 0, 1.0), (3, 0, 0.0), (3, 1, 0.0)], "station_id long, pos int, value double")
    at = lambda **k: [r.pos for r in evaluate.find_peaks(df, **k).orderBy("pos").collect()]
    assert at(height=0.6, prominence=0.1, distance=1) == [3, 7, 13]
    assert at(height=0.6, prominence=0.1, distance=5) == [7, 13]
    assert at(height=0.6, prominence=0.0, distance=1) == [1, 3, 7, 13, 15]
    assert at(height=2.0) == []


def test_peak_metrics(spark):
    def series(*stations):
        return spark.createDataFrame([(s, i, float(v)) for s, x in enumerate(stations) for i, v in enumerate(x)], "station_id long, pos int, value double")

    hill, flat = [0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0], [0.0] * 12
    truth, pred = series(hill, hill, flat, flat), series([0, 0, 0.8, 0] + [0.0] * 8, flat, hill, flat)
    [r] = evaluate.peak_metrics(truth, pred).collect()
    assert r.peaks == 2 and r.recall == 0.5 and abs(r.mae - 0.2) < 1e-12 and r.false_rate == 0.5


def test_paths_by_hand(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 5), (5, 2), (2, 4), (3, 3)], "a long, b long")
    got = {}
    for r in paths.shortest_hop_paths(e, pairs).orderBy("seq").collect():
        got.setdefault((r.a, r.b, r.dir), []).append(r.node)
    assert got == {(1, 5, 1): [1, 2, 3, 5], (5, 2, -1): [2, 3, 5], (3, 3, 1): [3]}
    reach = {(r.a, r.b): (r.there, r.back) for r in paths.reachability(e, pairs, 2).collect()}
    assert reach == {(1, 5): (None, None), (5, 2): (None, 2), (2, 4): (None, None), (3, 3): (0, 0)}


def test_nearest_line_far_off(spark):
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, 50.0, 4.0)], "station_id long, lat double, lon double")
    seg = spark.createDataFrame([(7, 50.0, 4.0, 50.0, 4.5), (8, 51.0, 4.0, 51.0, 4.1)], "line_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.station_id: (r.line_id, r.km) for r in paths.nearest_line(p, seg, 100.0).collect()}
    assert got[2] == (7, 0.0) and got[1][0] == 7 and 4000 < got[1][1] < 5000
    assert [tuple(r)[1:] for r in paths.nearest_line(p.where("station_id = 2"), seg.where("false"), 10_000.0).collect()] == [(None, None)]
