"""Medians of odd grids."""

import random
import statistics

import pytest

from gaugeloom.operators import raster


def test_median_filter_odd_grids(spark):
    """Grids of one cell, holes, nulls, cells that repeat and several tiles, against plain Python; no join of exploded cells."""
    rnd = random.Random(2)
    for h, w in ((1, 1), (3, 2), (140, 6)):
        z = [(r, c, None if rnd.random() < 0.1 else rnd.uniform(-1, 1)) for r in range(h) for c in range(w) if rnd.random() > 0.1 or (r, c) in ((0, 0), (h - 1, w - 1))]
        z += [(0, 0, 0.5)]
        df = raster.median_filter(spark.createDataFrame(z, "row int, col int, z double"))
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
        cells = {}
        for r, c, v in z:
            cells.setdefault((r, c), []).append(v)
        back = lambda x, m: -x - 1 if x < 0 else 2 * m - 1 - x if x >= m else x
        got = {(r.row, r.col): r.z for r in df.collect()}
        assert got.keys() == cells.keys()
        for r, c in cells:
            near = [v for a in range(-2, 3) for b in range(-2, 3) for v in cells.get((back(r + a, h), back(c + b, w)), []) if v is not None]
            assert got[r, c] == pytest.approx(statistics.median(near)) if near else got[r, c] is None
    assert raster.median_filter(spark.createDataFrame([], "row int, col int, z double")).collect() == []
