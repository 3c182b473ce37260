"""Lagged correlations of odd series."""

import math
import random

import numpy as np

from gaugeloom.operators import timeseries


def test_lagged_corr_odd_series(spark):
    """Gaps, nulls, still and short series, against numpy; lags aren't rows, and nothing is broadcast."""
    rnd = random.Random(5)
    water, rain_of = [], []
    for i in range(8):
        for p in range(40):
            if i != 2 or rnd.random() > 0.3:
                water.append((i, p, None if i == 3 and p % 5 == 0 else 1.1 if i == 4 else rnd.uniform(-1, 1)))
            if i != 5 or p < 7:
                rain_of.append((i, p + 3 * (i == 6), rnd.uniform(-1, 1)))
    one, two = (spark.createDataFrame(x, "station_id long, pos int, value double").repartition(3) for x in (water, rain_of))
    df = timeseries.lagged_corr_gate(one, two)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" in plan
    got = {r.station_id: r for r in df.collect()}
    a, b = {(i, p): v for i, p, v in water}, {(i, p): v for i, p, v in rain_of}
    for i in range(8):
        best = None
        for lag in range(-24, 25):
            both = [(v, b[i, p + lag]) for (j, p), v in a.items() if j == i and (i, p + lag) in b]
            if len(both) >= 8:
                known = np.array([x for x in both if x[0] is not None])
                best = max(best or 0.0, 0.0 if i == 4 else abs(np.corrcoef(known.T)[0, 1]))
        assert best is None and i not in got or math.isclose(got[i].best, best, abs_tol=1e-12) and math.isclose(got[i].gate, 0.05 + 0.95 * best**2, abs_tol=1e-12)
    assert got[4].best == 0.0 and 5 not in got
