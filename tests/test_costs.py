"""Least-cost paths and rain windows against plain Python."""

import heapq
import math
import random

import numpy as np
import pytest

from gaugeloom.operators import costs


def dijkstra(cost, sources, mean):
    far = {s: 0.0 for s in sources if s in cost}
    heap = [(0.0, s) for s in far]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > far[r, c]:
            continue
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                to = (r + dr, c + dc)
                if (dr or dc) and to in cost:
                    new = d + ((cost[r, c] + cost[to]) / 2 * math.hypot(dr, dc) if mean else cost[to])
                    if new < far.get(to, math.inf):
                        far[to] = new
                        heapq.heappush(heap, (new, to))
    return far


@pytest.mark.parametrize("mean", [True, False])
def test_cost_distance(spark, mean):
    """A winding wall, holes, two sources and an island that nothing reaches."""
    rnd = random.Random(7)
    cost = {(r, c): rnd.uniform(0.1, 3) for r in range(-5, 30) for c in range(40) if not (c == 20 and r < 25) and not (c == 30 and r > -3) and rnd.random() > 0.05}
    cost |= {(100, 100): 1.0}
    sources = [(0, 1), (20, 3), (77, 77)]
    df = spark.createDataFrame([(*k, v) for k, v in cost.items()], "row int, col int, cost double").repartition(3)
    progress = []
    out = costs.cost_distance(df, spark.createDataFrame(sources, "row int, col int"), 8, mean, progress).cache()
    got = {(r.row, r.col): r for r in out.collect()}
    want = dijkstra(cost, sources, mean)
    assert got.keys() == want.keys() and all(math.isclose(got[k].dist, want[k], abs_tol=1e-9) for k in want)
    assert (100, 100) not in got and len(progress) <= 30
    ends = [(1, 25, 35), (2, -3, 39), (3, 0, 1), (4, 100, 100), (5, 29, 0)]
    ends = [e for e in ends if e[1:] in got or e[0] == 4]
    paths = {}
    for r in sorted(costs.cost_paths(out, spark.createDataFrame(ends, "id long, row int, col int"), 8).collect(), key=lambda r: r.seq):
        paths.setdefault(r.id, []).append((r.row, r.col))
    assert 4 not in paths and len(paths) == len(ends) - 1
    for i, r, c in ends:
        if i in paths:
            p = paths[i]
            assert p[0] == (r, c) and p[-1] in sources and all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(p, p[1:]))
            total = sum((cost[a] + cost[b]) / 2 * math.dist(a, b) if mean else cost[a] for a, b in zip(p, p[1:]))
            assert math.isclose(total, want[r, c], abs_tol=1e-9)
    empty = costs.cost_distance(df.limit(0), spark.createDataFrame(sources, "row int, col int"))
    assert empty.collect() == [] and costs.cost_paths(empty, spark.createDataFrame(ends, "id long, row int, col int")).collect() == []


@pytest.mark.parametrize("window", ["ref", "centered"])
def test_rain_at_stations(spark, window):
    rng = np.random.default_rng(1)
    z = rng.uniform(0, 5, size=(3, 12, 15))
    gone = rng.random(z.shape) < 0.1
    cells = spark.createDataFrame([(t, r + 4, c - 2, None if (t + r + c) % 17 == 0 else float(z[t, r, c])) for t in range(3) for r in range(12) for c in range(15) if not gone[t, r, c]], "ts int, row int, col int, z double")
    full = np.zeros((3, 40, 40))
    for t, r, c, v in (tuple(x) for x in cells.collect()):
        full[t, r + 10, c + 10] = v or 0.0
    spots = [(1, 9, 5), (2, 4, -2), (3, 15, 12), (4, 10, 0), (5, 16, 13)]
    got = {(r.station_id, r.ts): r for r in costs.rain_at_stations(cells, spark.createDataFrame(spots, "station_id long, row int, col int"), window=window).collect()}
    more = 0 if window == "ref" else 1
    for i, r, c in spots:
        for t in range(3):
            for h in (1, 2, 3, 4):
                want = full[t, r + 10 - h : r + 10 + h + more, c + 10 - h : c + 10 + h + more].sum()
                assert np.isclose(got[i, t][f"r{2 * h + 1}x{2 * h + 1}"], want)
    seen = {(t, r, c): v for t, r, c, v in (tuple(x) for x in cells.collect())}
    assert all(got[i, t].r1x1 == seen.get((t, r, c)) for i, r, c in spots for t in range(3))
    assert costs.rain_at_stations(cells.limit(0), spark.createDataFrame(spots, "station_id long, row int, col int")).collect() == []


def test_building_costs(spark):
    cells = spark.createDataFrame([(0, 0, 2.0), (0, 1, 2.5), (1, 0, 2.4), (1, 1, 1.0)], "row int, col int, z double")
    got = {(r.row, r.col): (r.cost, r.building) for r in costs.building_costs(cells, (0, 0)).collect()}
    assert got == {(0, 0): (0.25, False), (0, 1): (1000.0, True), (1, 0): (2.4**2, False), (1, 1): (0.0625, False)}
