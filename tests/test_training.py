"""Training rows on small cases: gaps, short weeks, denied stations, missing paths."""

import numpy as np

from gaugeloom.operators import training


def table(spark, rows):
    return spark.createDataFrame(rows, "station_id long, week int, pos int, value double")


def test_week_quality(spark):
    calm = [(1, 0, p, 1.0 + 0.1 * (p % 2)) for p in range(6)]
    jump = [(1, 1, p, 1.0 if p < 3 else 2.0) for p in range(6)]
    far = [(1, 2, p, 9.0) for p in range(6)]
    rows = [*calm, *jump, *far, (1, 3, 0, 1.0), *[(1, 4, p, 1.0) for p in range(20)]]
    got = {r.week: r.kept for r in training.week_quality(table(spark, rows)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True}  # one step has no rise


def test_significant_weeks(spark):
    """A spike goes, and without it nothing changes; a slope stays."""
    flat = [(1, 0, p, 5.0 + (9.0 if p == 10 else 0.0)) for p in range(40)]
    slope = [(1, 1, p, 5.0 + 0.1 * p) for p in range(40)]
    rows = training.significant_weeks(table(spark, flat + slope)).collect()
    inside = [r for r in rows if r.week == 0 and 3 <= r.pos < 37]
    assert {r.value for r in inside} == {5.0} and [r.pos for r in inside if r.replaced] == [10]
    assert {r.significant for r in rows if r.week == 1} == {True}


def test_samples(spark):
    rng = np.random.default_rng(3)
    value = {(s, w, p): float(rng.normal()) for s in (1, 2, 3, 4) for w in range(4) for p in range(3) if (s, w) != (2, 1) and not (s == 3 and w > 0)}
    seg = table(spark, [(*k, v) for k, v in value.items()])
    nb = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 1), (4, 1, 1)], "station_id long, nb_id long, rank int")
    pairs = training.usable_neighbors(seg, nb, 2, [4])
    assert {(r.station_id, r.nb_id) for r in pairs.collect()} == {(1, 2), (2, 1)}  # 3 has one week, 4 is denied, 1 isn't its own neighbour
    weeks = training.shared_weeks(seg, pairs)
    assert {tuple(r) for r in weeks.collect()} == {(s, w) for s in (1, 2) for w in (0, 2, 3)}
    drawn = {tuple(r) for r in training.one_week(weeks, 1).collect()}
    assert len(drawn) == 2 and drawn <= {tuple(r) for r in weeks.collect()} and drawn == {tuple(r) for r in training.one_week(weeks, 1).collect()}
    med = {s: np.median([v for k, v in value.items() if k[0] == s]) for s in (1, 2)}
    got = training.training_samples(seg, pairs, weeks).collect()
    assert len(got) == 2 * 3 * 3
    for r in got:
        v = value[r.nb_id, r.week, r.pos]
        assert np.isclose(r.x, v - med[r.nb_id]) and r.valid == (v > 0) and np.isclose(r.y, value[r.station_id, r.week, r.pos] - med[r.station_id])


def test_edge_vectors(spark):
    st = spark.createDataFrame([(i, 50.0 + i, 4.0 + 2 * i, 10.0 * i, 1.0 + i) for i in (1, 2, 3)], "station_id long, lat double, lon double, elevation double, width double")
    stats = spark.createDataFrame([(1, 2, 7.0, 0.1, 0.2, 1.0, 2.0, 3.0, 4.0, 5.0, 9.0, 6.0)], "src long, dst long, distance double, dx double, dy double, mean double, std double, min double, max double, median double, key_elevation double, src_elevation double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "station_id long, nb_id long")
    got = {(r.station_id, r.nb_id): r for r in training.edge_vectors(pairs, stats, st).collect()}
    for key, way in (((1, 2), -1), ((2, 1), 1)):
        assert tuple(got[key])[2:12] == (7.0, 0.1, 0.2, 1.0, 2.0, 3.0, 4.0, 5.0, 3.0, way)
    assert tuple(got[1, 3])[2:] == (-1.0, 2.0, 4.0, -1.0, -1.0, -1.0, -1.0, -1.0, 20.0, 0, 4.0, 2.0, 51.0, 6.0, 53.0, 10.0)


def test_path_profile_without_a_path(spark):
    none = spark.createDataFrame([], "id long, seq int, row int, col int")
    cells = spark.createDataFrame([(0, 0, 1.0)], "row int, col int, z double")
    nodes = spark.createDataFrame([], "id long, seq int, lat double, lon double")
    [r] = training.path_profile(none, cells, cells.withColumnRenamed("z", "slope"), nodes, spark.createDataFrame([(5,)], "id long")).collect()
    assert r.id == 5 and set(tuple(r)[1:]) == {-1.0}
