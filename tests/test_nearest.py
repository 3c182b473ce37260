"""Nearest lines among long ones that cross."""

import math
import random

import numpy as np
import pytest

from gaugeloom.operators import joins, nearest, paths


def crossing(spark, n, m):
    rnd = random.Random(9)
    seg = [(k % 97, *(x for _ in range(2) for x in (rnd.uniform(50, 51), rnd.uniform(4, 5)))) for k in range(m)]
    spots = [(i, rnd.gauss(50.5, 0.15), rnd.gauss(4.0, 0.15)) for i in range(n)] + [(-1, None, 4.0), (-2, 10.0, 60.0)]
    return seg, spots, spark.createDataFrame(spots, "station_id long, lat double, lon double"), spark.createDataFrame(seg, "line_id long, lat1 double, lon1 double, lat2 double, lon2 double")


def brute(seg, lat, lon):
    s = np.array(seg)
    km = nearest._km(nearest._ecef(np.array([lat]), np.array([lon])), a := nearest._ecef(s[:, 1], s[:, 2]), ab := nearest._ecef(s[:, 3], s[:, 4]) - a, (ab * ab).sum(axis=0))
    return km.min(), int(s[km == km.min(), 0].min())


def test_lines_that_cross_are_searched_by_halves():
    """Long lines all over a box: few of the pairs are compared."""
    rng = np.random.default_rng(1)
    place = lambda n: nearest._ecef(rng.uniform(50, 51, n), rng.uniform(4, 5, n))
    p, a, b = place(1000), place(20_000), place(20_000)
    best, km, compared = nearest.nearest_of(p, a, b)
    assert compared < p.shape[1] * a.shape[1] / 4
    for i in range(0, 1000, 50):
        told = nearest._km(p[:, i : i + 1], a, b - a, ((b - a) ** 2).sum(axis=0))
        assert told.argmin() == best[i] and told.min() == km[i]


def small_blocks(monkeypatch):
    """Cells are split into blocks of few points and segments."""
    monkeypatch.setattr(nearest, "POINTS", 20)
    monkeypatch.setattr(nearest, "SEGMENTS", 50)


@pytest.mark.parametrize("split", [False, True])
def test_line_within_of_lines_that_cross(spark, monkeypatch, split):
    """Against all pairs, in cells with few and with many points and segments."""
    if split:
        small_blocks(monkeypatch)
    seg, spots, points, lines = crossing(spark, 300, 800)
    got = {r.station_id: (r.line_id, r.km) for r in joins.line_within(points, lines, 1.0).collect()}
    assert got.keys() == {s[0] for s in spots} and got[-1] == got[-2] == (None, None)
    for i, lat, lon in spots:
        if lat is not None:
            km, line = brute(seg, lat, lon)
            assert got[i][0] == (line if km <= 1.0 else None) and (km > 1.0 or math.isclose(got[i][1], km, abs_tol=1e-9))


@pytest.mark.parametrize("split", [False, True])
def test_nearest_of_lines_that_cross(spark, monkeypatch, split):
    """Against all pairs, among them points far off, in cells with few and with many points and segments."""
    if split:
        small_blocks(monkeypatch)
    seg, spots, points, lines = crossing(spark, 300, 800)
    got = {r.station_id: r for r in paths.nearest_line(points, lines).collect()}
    assert got.keys() == {s[0] for s in spots} and got[-1].km is None
    for i, lat, lon in spots:
        if lat is not None:
            km, line = brute(seg, lat, lon)
            assert math.isclose(got[i].km, km, abs_tol=1e-9) and got[i].line_id == line


def test_bounds_of_few_vertices(spark, monkeypatch):
    """Vertices of a coarse grid stand for all: a bound is never less than the distance of the nearest vertex, nor more than a cell's width above it."""
    monkeypatch.setattr(nearest, "STANDS", 64)
    seg, spots, points, lines = crossing(spark, 300, 800)
    got = {r.station_id: r.bound for r in nearest.bounded(points, lines).collect()}
    ends = [(0, s[1], s[2], s[1], s[2]) for s in seg]
    assert all(-1e-9 <= got[i] - brute(ends, lat, lon)[0] <= 111 / 8 * 2**0.5 + 1 for i, lat, lon in spots if lat is not None) and -1 not in got


def test_dist_to_lines_that_cross(spark):
    """The same distance in three units."""
    seg, spots, points, lines = crossing(spark, 100, 400)
    got = {r.station_id: r for r in paths.dist_to_lines(points, lines).collect()}
    for i, lat, lon in spots:
        if lat is not None:
            km, _ = brute(seg, lat, lon)
            assert math.isclose(got[i].m, km * 1000, abs_tol=1e-6) and math.isclose(got[i].km, km, abs_tol=1e-9) and math.isclose(got[i].km100, km / 100, abs_tol=1e-9)
