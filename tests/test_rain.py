"""Rain windows of odd tables and of many stations."""

import math

import pytest

from __spark_entry__ import oracle_sql, queries
from gaugeloom.operators import costs

from . import oracle


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rain(spark, window):
    """Two hours of 12 rows, the second one with three rows only; a cell of the first is huge."""
    z = {(t, r, c): 1e16 if (t, r, c) == (0, 0, 0) else 0.1 + (7 * r + 3 * c + t) % 11 / 7 for t in (0, 1) for r in range(3 if t else 12) for c in range(9)}
    cells = spark.createDataFrame([(*k, v) for k, v in z.items()], "ts int, row int, col int, z double")
    spots = [(i, 11, 8) for i in range(50)] + [(100, 6, 4), (101, 1, 1), (102, 7, 4), (103, 40, 40), (104, 5, 4)]
    return z, spots, costs.rain_at_stations(cells, spark.createDataFrame(spots, "station_id long, row int, col int"), window=window)


@pytest.mark.parametrize("window", ["ref", "centered"])
def test_rain_of_a_partial_hour(spark, window):
    """As the SQL says: no row where no cell is near, and sums of the cells that are there, however large others are."""
    z, spots, out = rain(spark, window)
    got = {(r.station_id, r.ts): r for r in out.collect()}
    want = {(i, t): (r, c) for i, r, c in spots for t in (0, 1) if any((t, r + a, c + b) in z for a in range(-4, 5) for b in range(-4, 5))}
    assert got.keys() == want.keys() and (100, 1) in got and (102, 1) not in got and not any(i == 103 for i, _ in got)
    for (i, t), (r, c) in want.items():
        assert got[i, t].r1x1 == z.get((t, r, c))
        for h in (1, 2, 3, 4):
            near = range(-h, h + (window == "centered"))
            told = sum(z.get((t, r + a, c + b), 0.0) for a in near for b in near)
            assert math.isclose(got[i, t][f"r{2 * h + 1}x{2 * h + 1}"], told, rel_tol=1e-12)


@pytest.mark.parametrize("window", ["ref", "centered"])
def test_rain_windows_are_told_once_a_place(spark, window):
    """Stations join windows of places; nothing as long as stations times corners is made or broadcast."""
    plan = plan_of(rain(spark, window)[2])
    assert "Broadcast" not in plan and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("name", ["rain_windows", "rain_windows_centered"])
def test_rain_queries_of_a_partial_hour(spark, tmp_path, name):
    """130 rows of cells: the second hour ends after 30; against the query's SQL."""
    spark.createDataFrame([(i, [((i * 31 + k * 17) % 101 - 50) / 64 for k in range(64)], 0) for i in range(130)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "s", 1, 0.0) for i in range(120)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    assert not oracle.difference(queries()[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), oracle_sql()[name])
