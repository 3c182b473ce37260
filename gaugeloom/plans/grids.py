"""Registered queries of least-cost paths and of rain around stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import costs
from . import queries as Q
from . import views as V
from .queries import query, rounded

# Cells cost a little more than their height's size; paths start at the middle of every 250th row

COSTS = """co AS (SELECT row, col, 0.1::DOUBLE + abs(z) AS cost FROM cells), cd(row, col, dist) USING KEY (row, col) AS (SELECT row, col, 0.0::DOUBLE FROM co WHERE row % 250 = 0 AND col = 32
UNION (SELECT n.row, n.col, min(cd.dist + (n.cost + a.cost) / 2 * sqrt(abs(n.row - a.row) + abs(n.col - a.col))) AS d FROM cd JOIN co a ON a.row = cd.row AND a.col = cd.col, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dr, dc)
JOIN co n ON n.row = a.row + dr AND n.col = a.col + dc LEFT JOIN recurring.cd k ON k.row = n.row AND k.col = n.col GROUP BY n.row, n.col HAVING min(cd.dist + (n.cost + a.cost) / 2 * sqrt(abs(n.row - a.row) + abs(n.col - a.col))) < coalesce(any_value(k.dist), 1e300)))"""


def _distances(s: SparkSession, d: str) -> DataFrame:
    cost = V.cells(s, d).select("row", "col", (F.lit(0.1) + F.abs("z")).alias("cost"))
    return Q.stored(costs.cost_distance(cost, cost.where("row % 250 = 0 and col = 32"), tile=64), "cost-distance")


query("cost_distance", "cells", f", {COSTS} SELECT row, col, round(dist, 6) + 0.0 AS dist FROM cd")(lambda s, d: rounded(_distances(s, d).select("row", "col", "dist"), "dist"))


@query("cost_paths", "cells", f""", {COSTS}, fi AS MATERIALIZED (SELECT cd.*, co.cost FROM cd JOIN co USING (row, col)),
bk AS MATERIALIZED (SELECT x.row, x.col, arg_min((y.row, y.col), y.dist + (x.cost + y.cost) / 2 * sqrt(abs(x.row - y.row) + abs(x.col - y.col))) AS p FROM fi x, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dr, dc) JOIN fi y ON y.row = x.row + dr AND y.col = x.col + dc WHERE x.dist > 0 GROUP BY ALL),
tr AS (SELECT row::BIGINT AS id, 0 AS seq, row, col FROM fi WHERE row % 50 = 7 AND col = 5 UNION ALL SELECT id, seq + 1, p[1], p[2] FROM tr JOIN bk ON bk.row = tr.row AND bk.col = tr.col)
SELECT id, seq, row, col, round(dist, 6) + 0.0 AS dist FROM tr JOIN fi USING (row, col)""")
def _paths(s: SparkSession, d: str) -> DataFrame:
    dist = _distances(s, d)
    ends = dist.where("row % 50 = 7 and col = 5").select(F.col("row").cast("long").alias("id"), "row", "col")
    return rounded(costs.cost_paths(dist, ends, tile=64), "dist")


query("building_costs", "cells", """, li AS (SELECT 1.2::DOUBLE * z AS t FROM cells WHERE row = 8 AND col = 9)
SELECT row, col, round(CASE WHEN z > t THEN 1000 WHEN z < t THEN pow(z / 4, 2) ELSE pow(z, 2) END, 6) + 0.0 AS cost, z > t AS building FROM cells, li""")(lambda s, d: rounded(costs.building_costs(V.cells(s, d), (8, 9)), "cost"))

# Rain: a hundred rows of cells are an hour's grid; stations are the suppliers


def _hours(s: SparkSession, d: str) -> DataFrame:
    return V.cells(s, d).select(F.floor(F.col("row") / 100).cast("int").alias("ts"), (F.col("row") % 100).alias("row"), "col", F.abs("z").alias("z"))


def _points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select(k.alias("station_id"), (k * 37 % 100).cast("int").alias("row"), (k * 23 % 64).cast("int").alias("col"))


def _rain_sql(high: str) -> str:
    sums = ", ".join(f"round(coalesce(sum(CASE WHEN h.row BETWEEN p.row - {k} AND p.row + {k}{high} AND h.col BETWEEN p.col - {k} AND p.col + {k}{high} THEN z END), 0), 6) + 0.0 AS r{2 * k + 1}x{2 * k + 1}" for k in (1, 2, 3, 4))
    return f""", ho AS (SELECT row // 100 AS ts, row % 100 AS row, col, abs(z) AS z FROM cells), pp AS (SELECT s_suppkey AS station_id, s_suppkey * 37 % 100 AS row, s_suppkey * 23 % 64 AS col FROM supplier)
SELECT station_id, CAST(ts AS INT) AS ts, round(max(CASE WHEN h.row = p.row AND h.col = p.col THEN z END), 6) AS r1x1, {sums} FROM pp p JOIN ho h ON h.row BETWEEN p.row - 4 AND p.row + 4 AND h.col BETWEEN p.col - 4 AND p.col + 4 GROUP BY ALL"""


WINDOWS = ("r1x1", "r3x3", "r5x5", "r7x7", "r9x9")
query("rain_windows", "cells", _rain_sql(" - 1"))(lambda s, d: rounded(costs.rain_at_stations(_hours(s, d), _points(s, d)), *WINDOWS))
query("rain_windows_centered", "cells", _rain_sql(""))(lambda s, d: rounded(costs.rain_at_stations(_hours(s, d), _points(s, d), window="centered"), *WINDOWS))
