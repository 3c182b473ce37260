"""Every registered query with SQL against DuckDB, the others against numpy twins and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeloom.functions import scalars
from gaugeloom.operators import clean, evaluate, graph, interp, joins, raster, timeseries
from gaugeloom.plans import files, grids, models, more, network, queries, samples, variables  # noqa: F401  the others register theirs
from tests import oracle

SF = "/root/testdata/sf0.001"
SLOW = {"flood_fill", "flow_accumulation"}  # tested on small grids below


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SLOW))
def test_sql(spark, con, name):
    assert oracle.difference(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) == ""


@pytest.fixture(scope="module")
def bowl(spark):
    return spark.createDataFrame([(r, c, float((r - 3) ** 2 + (c - 3) ** 2) + 0.01 * r) for r in range(7) for c in range(7)], "row int, col int, z double")


def test_flow_accumulation(bowl):
    d = {(r.row, r.col): r.dir for r in raster.d8_direction(bowl).collect()}
    step = {code: (a, b) for a, b, code in raster.D8}
    acc = dict.fromkeys(d, 0)
    for cell in d:
        at = cell
        while True:
            acc[at] += 1
            if not d[at]:
                break
            at = (at[0] + step[d[at]][0], at[1] + step[d[at]][1])
    got = {(r.row, r.col): r.acc for r in raster.flow_accumulation(raster.d8_direction(bowl)).collect()}
    assert got == acc
    assert sum(v for k, v in got.items() if not d[k]) == 49


def test_flood_fill(spark):
    allowed = [(r, c) for r in range(6) for c in range(6) if c != 3 or r == 5]
    cells = spark.createDataFrame(allowed, "row int, col int")
    seed = spark.createDataFrame([(0, 0)], "row int, col int")
    assert {tuple(r) for r in raster.flood_fill(seed, cells).collect()} == set(allowed)
    walled = cells.where("not (row = 5 and col = 3)")
    assert {r.col for r in raster.flood_fill(seed, walled).collect()} == {0, 1, 2}


def test_cost_distance(spark):
    cost = spark.createDataFrame([(r, c, 1.0 + (r == 1 and c < 2) * 9) for r in range(3) for c in range(3)], "row int, col int, cost double")
    got = {(r.row, r.col): r.dist for r in raster.cost_distance(cost, spark.createDataFrame([(0, 0)], "row int, col int")).collect()}
    assert got[0, 0] == 0 and got[0, 1] == 1 and got[1, 2] == 2 and got[2, 0] == 4 and got[1, 0] == 10


@pytest.mark.parametrize("method", ["ordinary_kriging", "ked", "rbf_thin_plate"])
def test_weights(spark, method):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3)), 1.0, 0) for i in range(40)]
    st = spark.createDataFrame(rows, "station_id long, lat double, lon double, elevation double, width double, cluster int")
    nb = joins.knn_self(st, 8)
    w = interp.METHODS[method](nb, st).toPandas()
    assert np.allclose(w.groupby("station_id").w.sum(), 1) and not w.fallback.any()
    place = {r[0]: r for r in rows}
    for target, g in w.groupby("station_id"):
        if method == "ked":  # the drift is met as well
            assert np.isclose(sum(x * place[n][3] for n, x in zip(g.nb_id, g.w)), place[target][3], atol=1e-6)
        if method == "rbf_thin_plate":
            assert np.isclose(sum(x * place[n][1] for n, x in zip(g.nb_id, g.w)), place[target][1], atol=1e-6)


def test_kriging_falls_back(spark):
    st = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 0.0, 1.0, 1.0), (2, 0.0, 1.0, 1.0)], "station_id long, lat double, lon double, elevation double")
    nb = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 1.0)], "station_id long, nb_id long, rank int, dist double")
    assert all(r.fallback and abs(r.w - 0.5) < 1e-9 for r in interp.ked(nb, st).collect())


def test_suppress_spikes(spark):
    x = np.sin(np.arange(80) / 9)
    x[10:13] += 50
    x[30:38] += 50
    x[60:69] += 50
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "station_id long, pos int, value double")
    got = np.array([r.value for r in clean.suppress_spikes(df, z=6.0).orderBy("pos").collect()])
    assert abs(got[:60]).max() < 2 and (got[60:69] > 40).all()


def test_weeks_at_their_edges(spark):
    """A run must go beyond a week's end, unless that isn't asked for."""
    rows = [(s, f"2024-01-{d + 1:02d} 00:00:00", float(d)) for s, n in ((1, 7), (2, 8), (3, 6)) for d in range(n)]
    r = spark.createDataFrame(rows, "station_id long, t string, value double").select("station_id", F.to_timestamp("t").alias("ts"), "value")
    assert [x.station_id for x in timeseries.weekly_segments(r, 86400).collect()] == [2]
    assert sorted(x.station_id for x in timeseries.weekly_segments(r, 86400, require_successor=False).collect()) == [1, 2]


def test_ttest_p_value():
    assert abs(evaluate.t_p_value(2.228, 10) - 0.05) < 1e-4 and abs(evaluate.t_p_value(0.0, 5) - 1) < 1e-12 and abs(evaluate.t_p_value(12.706, 1) - 0.05) < 1e-4


def test_level_propagate(spark):
    e = spark.createDataFrame([(1, 0, 0.5), (2, 1, 1.0), (3, 1, 0.25)], "src long, dst long, alpha double")
    x = spark.createDataFrame([(n, 0, 1.0) for n in range(4)], "node long, pos int, value double")
    got = {r.node: r.value for r in graph.level_propagate(x, e, graph.hops_to_target(e, 0)).collect()}
    assert got == {0: 1 + 0.5 * 2.25, 1: 2.25, 2: 1.0, 3: 1.0}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.point_segment_km(scalars.ecef(F.lit(0.5), F.lit(0.5)), scalars.ecef(F.lit(0.0), F.lit(0.0)), scalars.ecef(F.lit(0.0), F.lit(1.0))).alias("d"),
        scalars.coord_pair(F.lit("(1.5, -2)")).alias("c"), scalars.decimal_comma(F.lit("12,34")).alias("n"), scalars.decimal_comma(F.lit("")).alias("e"),
    ).first()
    assert abs(row.d - 55.6) < 0.2 and tuple(row.c) == (1.5, -2.0) and row.n == 12.34 and row.e is None


def test_paired_ttest_p(spark):
    """Two-sided p against values from a table of Student's t."""
    for t, dof, p in ((2.228, 10, 0.05), (1.812, 10, 0.1), (2.0, 1000000, 0.0455)):
        assert abs(evaluate.t_p_value(t, dof) - p) < 5e-4
    rows = [("a", 1, i, 0.1, 0.1 + d) for i, d in enumerate((0.3, 0.1, 0.2, 0.25))] + [("b", 1, i, 0.1, 0.1) for i in range(4)]
    [got] = evaluate.paired_ttest_p(spark.createDataFrame(rows, "method string, station_id long, pos long, tgt double, out double"), "a", "b").collect()
    assert abs(got.p - evaluate.t_p_value(got.t, 3)) < 1e-12 and 0 < got.p < 0.05


def test_split_by_cluster(spark):
    """Each station has one role, and a training cluster's neighbours train too."""
    from gaugeloom.operators import samples

    st = spark.createDataFrame([(i, 50.0 + i % 4, 4.0 + i % 3) for i in range(60)], "station_id long, lat double, lon double")
    nb = spark.createDataFrame([(i, (i + 1) % 60) for i in range(60)], "station_id long, nb_id long")
    got = {r.station_id: r.role for r in samples.split_by_cluster(st, nb, 6, 3, 1).collect()}
    assert len(got) == 60 and set(got.values()) == {"train", "test"}
