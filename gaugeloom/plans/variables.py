"""Registered queries of kriging with rain, frozen models and kernel neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, learned
from . import queries as Q
from . import views as V
from .models import _between
from .queries import query, rounded

# Rain of a station and step: orders of customers by day of the year; most steps are dry

RAIN = """rain AS (SELECT s.station_id, s.pos, coalesce(r, 0) AS value FROM series s LEFT JOIN (SELECT o_custkey % 500 AS station_id, dayofyear(o_orderdate) % 64 AS pos, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1e7) AS r FROM orders GROUP BY ALL) o ON o.station_id = s.station_id AND o.pos = s.pos)"""


def _levels(s: SparkSession, d: str) -> DataFrame:
    """Series with gaps: one step in eleven is missing, by station and step."""
    return V.series(s, d).withColumn("value", F.when((F.col("station_id") + F.col("pos")) % 11 != 0, F.col("value")))


def _sides(n: int) -> str:
    """Station with its n nearest: n1, h1 (distance from the target), h12 (between them) and so on; stations in order of rank."""
    ids = ", ".join(f"max(CASE WHEN rank = {i} THEN nb_id END) AS n{i}" for i in range(1, n + 1))
    at = ", ".join(f"{_between('s', f'p{i}')} AS h{i}" for i in range(1, n + 1))
    apart = ", ".join(f"{_between(f'p{i}', f'p{j}')} AS h{i}{j}" for i in range(1, n + 1) for j in range(i + 1, n + 1))
    joins = " ".join(f"JOIN stations p{i} ON p{i}.station_id = n{i}" for i in range(1, n + 1))
    return f"ni AS (SELECT station_id, {ids} FROM nb GROUP BY ALL), ge AS (SELECT s.station_id, {', '.join(f'n{i}' for i in range(1, n + 1))}, {at}, {apart} FROM ni JOIN stations s USING (station_id) {joins})"


query("cokriging", "stations nb series", f""", {RAIN}, {_sides(2)}, cc AS (SELECT *, exp(-0.75 * h1) AS r1, exp(-0.75 * h2) AS r2, exp(-0.75 * h12) AS r, 0.5 * sqrt(2.0) AS x FROM ge),
qf AS (SELECT *, 2 * (2.1 + 1e-10 - 2 * r) AS pp, 2 * (1.05 + 1e-10 - r) AS qq, 2 * x * (1 - r) AS pq, 2 * (r1 - r2) - (2 * r - 2.1 - 1e-10) AS ep, x * (r1 - r2) - x * (r - 1) AS eq FROM cc), ww AS (SELECT *, (ep * qq - eq * pq) / (pp * qq - pq * pq) AS a, (eq * pp - ep * pq) / (pp * qq - pq * pq) AS b FROM qf)
SELECT w.station_id, y1.pos, round(a * y1.value + (1 - a) * y2.value + b * d1.value - b * d2.value, 4) + 0.0 AS out FROM ww w JOIN series y1 ON y1.station_id = n1 JOIN series y2 ON y2.station_id = n2 AND y2.pos = y1.pos JOIN rain d1 ON d1.station_id = n1 AND d1.pos = y1.pos JOIN rain d2 ON d2.station_id = n2 AND d2.pos = y1.pos""")(
    lambda s, d: rounded(drift.cokriging(Q.neighbors(s, d).where("rank <= 2"), V.stations(s, d), V.series(s, d), V.rain(s, d), kind="exponential", nugget1=0.1, nugget2=0.05, collocated=False), "out", digits=4)
)
query("cokriging_collocated")(lambda s, d: rounded(drift.cokriging(Q.neighbors(s, d), V.stations(s, d), V.series(s, d), V.rain(s, d), nugget1=0.1, nugget2=0.1), "out"))


def _schur(cov: str, variance: str, levels: str, ridge: str, drift_of: str) -> str:
    """Three neighbours: the inverse of their covariance by its cofactors, then the drift's 2 x 2 system of each step."""
    pairs = {(1, 2): "h12", (1, 3): "h13", (2, 3): "h23"}
    c = {(i, j): f"c{min(i, j)}{max(i, j)}" if i != j else "c" for i in (1, 2, 3) for j in (1, 2, 3)}
    minor = lambda i, j: [(a, b) for a in (1, 2, 3) if a != i for b in (1, 2, 3) if b != j]

    def cofactor(i: int, j: int) -> str:
        m = [c[x] for x in minor(i, j)]
        return f"{'-' if (i + j) % 2 else ''}({m[0]} * {m[3]} - {m[1]} * {m[2]})"

    inverse = ", ".join(f"{cofactor(i, j)} / det AS i{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    row = lambda i, v: " + ".join(f"i{i}{j} * {v}{j}" for j in (1, 2, 3))
    y = " ".join(f"JOIN {levels} y{i} ON y{i}.station_id = n{i} AND y{i}.pos = o.pos JOIN rain d{i} ON d{i}.station_id = n{i} AND d{i}.pos = o.pos" for i in (1, 2, 3))
    total = lambda e: " + ".join(e.format(i=i) for i in (1, 2, 3))
    return f"""tt AS MATERIALIZED (SELECT g.*, o.pos, o.value AS d0, {", ".join(f"y{i}.value AS y{i}, d{i}.value AS d{i}" for i in (1, 2, 3))} FROM ge g JOIN rain o ON o.station_id = g.station_id {y}),
co AS (SELECT ge.station_id, {variance} AS c, {", ".join(f"{cov.format(h=h)} AS c{i}{j}" for (i, j), h in pairs.items())}, {", ".join(f"{cov.format(h=f'h{i}')} AS k{i}" for i in (1, 2, 3))} FROM ge LEFT JOIN ex USING (station_id)),
cd AS (SELECT *, c * (c * c - c23 * c23) - c12 * (c12 * c - c23 * c13) + c13 * (c12 * c23 - c * c13) AS det FROM co), ci AS (SELECT station_id, k1, k2, k3, {inverse} FROM cd),
ab AS (SELECT *, {", ".join(f"i{i}1 + i{i}2 + i{i}3 AS a{i}, {row(i, 'k')} AS b{i}" for i in (1, 2, 3))} FROM ci), {drift_of},
ed AS (SELECT ab.*, z.pos, z.y1, z.y2, z.y3, z.z0, z.z1, z.z2, z.z3, z.sd, z.h1, z.h2, z.h3, {", ".join(f"{row(i, 'z')} AS e{i}" for i in (1, 2, 3))} FROM ab JOIN z USING (station_id)),
es AS (SELECT *, {total("a{i}")} + {ridge} AS s11, {total("e{i}")} AS s12, {total("z{i} * e{i}")} + {ridge} AS s22, {total("b{i}")} - 1 AS r1, {total("z{i} * b{i}")} - z0 AS r2 FROM ed),
el AS (SELECT *, (r1 * s22 - r2 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS mu, (r2 * s11 - r1 * s12) / nullif(s11 * s22 - s12 * s12, 0) AS lam, s11 * s22 - s12 * s12 AS dd FROM es),
eo AS (SELECT *, {total("(b{i} - mu * a{i} - lam * e{i}) * y{i}")} AS best, {total("(b{i} - mu * a{i} - lam * e{i}) * k{i}")} AS wc FROM el)"""


query("ked_interval", "stations nb series", f""", {RAIN}, {_sides(3)}, ex AS (SELECT station_id FROM ge), {_schur("0.9::DOUBLE * exp(-3 * {h} / 10)", "1.0::DOUBLE + 1e-6", "series", "1e-6", "z AS (SELECT *, d0 AS z0, d1 AS z1, d2 AS z2, d3 AS z3, 0 AS sd FROM tt)")}
SELECT station_id, pos, round(best, 3) + 0.0 AS out, round(sqrt(greatest(0.9 - wc + mu + lam * z0, 0)), 3) + 0.0 AS sd FROM eo WHERE greatest(z1, z2, z3) > least(z1, z2, z3)""")(
    lambda s, d: rounded(_wet(drift.ked_interval(Q.neighbors(s, d).where("rank <= 3"), V.stations(s, d), V.series(s, d), V.rain(s, d), "exponential", 1.0, 10.0, 0.1, 1e-6), s, d), "out", "sd", digits=3)
)


def _wet(out: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """Steps at which rain isn't the same at all three neighbours: elsewhere the ridge alone decides, and rounding errors show."""
    r = V.rain(s, d).select(F.col("station_id").alias("nb_id"), "pos", "value")
    same = Q.neighbors(s, d).where("rank <= 3").join(r, "nb_id").groupBy("station_id", "pos").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return out.join(same.where("low < high").select("station_id", "pos"), ["station_id", "pos"], "left_semi")


NORM = """z AS (SELECT *, greatest(-5, least(5, (d0 - m) / (sd + 1e-12))) AS z0, greatest(-5, least(5, (d1 - m) / (sd + 1e-12))) AS z1, greatest(-5, least(5, (d2 - m) / (sd + 1e-12))) AS z2, greatest(-5, least(5, (d3 - m) / (sd + 1e-12))) AS z3
FROM (SELECT *, (d1 + d2 + d3) / 3 AS m, list_stddev_pop([d1, d2, d3]) AS sd FROM tt))"""
query("ked_fast", "stations nb series", f""", {RAIN}, {_sides(3)}, ex AS (SELECT station_id, 0.1::DOUBLE * greatest(median(v), 1e-6) AS extra FROM (SELECT ge.station_id, pos, var_pop(value) AS v FROM ge JOIN series s ON s.station_id IN (n1, n2, n3) GROUP BY ALL) GROUP BY ALL),
{_schur("2 * exp(-pi() / 4 * pow({h} / 4, 2))", "2 + extra + 1e-10", "series", "0", NORM)}
SELECT station_id, pos, round(CASE WHEN sd < 1e-6 OR abs(dd) < 1e-10 THEN (y1 / h1 + y2 / h2 + y3 / h3) / (1 / h1 + 1 / h2 + 1 / h3 + 1e-12) ELSE best END, 4) + 0.0 AS out, sd < 1e-6 OR abs(dd) < 1e-10 AS fallback FROM eo""".replace("list_stddev_pop([d1, d2, d3])", "sqrt((pow(d1 - (d1 + d2 + d3) / 3, 2) + pow(d2 - (d1 + d2 + d3) / 3, 2) + pow(d3 - (d1 + d2 + d3) / 3, 2)) / 3)"))(
    lambda s, d: rounded(drift.ked_fast(Q.neighbors(s, d).where("rank <= 3"), V.stations(s, d), V.series(s, d), V.rain(s, d)), "out", digits=4)
)
query("ked_fast_gaps")(lambda s, d: rounded(drift.ked_fast(Q.neighbors(s, d), V.stations(s, d), _levels(s, d), V.rain(s, d), lag=1, smooth=3), "out"))

# Frozen models: a few fixed numbers as layers

WIDE = [([[0.8, -0.3], [-0.5, 0.9], [0.2, 0.4]], [0.1, 0.0, -0.2]), ([[0.6, -0.4, 0.5], [0.3, 0.7, -0.1]], [0.05, -0.05]), ([[0.9, -0.6]], [0.1])]
X_NET, Y_NET = [([[0.7, 0.2], [-0.4, 0.5]], [0.3, 0.1]), ([[0.5, 0.8]], [0.2])], [([[-0.3, 0.4], [0.6, 0.1]], [0.2, 0.4]), ([[0.9, 0.3]], [0.1])]


def _net_sql(name: str, source: str, features: list[str], layers) -> str:
    """CTEs that apply the layers one by one; the last gives s."""
    out, here, names = [], source, features
    for i, (w, b) in enumerate(layers):
        values = [" + ".join(f"{x}::DOUBLE * {n}" for x, n in zip(row, names)) + f" + {c}::DOUBLE" for row, c in zip(w, b)]
        last = i == len(layers) - 1
        new = ["s"] if last else [f"l{i}_{j}" for j in range(len(w))]
        out.append(f"{name}{i} AS (SELECT station_id, nb_id, " + ", ".join(f"{v if last else f'greatest(0, {v})'} AS {n}" for v, n in zip(values, new)) + f" FROM {here})")
        here, names = f"{name}{i}", new
    return ", ".join(out) + f", {name} AS (SELECT * FROM {here})"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return Q.neighbors(s, d).select("station_id", "nb_id", "rank", "dist")


query("score_weight_model", "stations nb", f""", fe AS (SELECT station_id, nb_id, 1 / (dist + 1e-6) AS f1, 1 / (rank + 1e-6) AS f2 FROM nb), {_net_sql("ne", "fe", ["f1", "f2"], WIDE)}, ac AS (SELECT *, 1 / (1 + exp(-s)) AS a FROM ne)
SELECT station_id, nb_id, round(a / (sum(a) OVER (PARTITION BY station_id) + 1e-8), 6) + 0.0 AS w FROM ac""")(lambda s, d: rounded(learned.score_weight_model(_edges(s, d), ["dist", "rank"], WIDE), "w"))
S2, LX, T2 = math.log(2) ** 2, math.log(2) + 1e-6, math.log1p(math.exp(-3.0)) ** 2
query("latent_kriging", "stations nb", f""", fe AS (SELECT station_id, nb_id, dist AS f1, rank AS f2 FROM nb WHERE rank <= 2), {_net_sql("nx", "fe", ["f1", "f2"], X_NET)}, {_net_sql("ny", "fe", ["f1", "f2"], Y_NET)},
xy AS (SELECT station_id, nb_id, greatest(nx.s, 0) / (sum(greatest(nx.s, 0)) OVER w + 1e-8) / {LX} AS x, greatest(ny.s, 0) / (sum(greatest(ny.s, 0)) OVER w + 1e-8) / {LX} AS y FROM nx JOIN ny USING (station_id, nb_id) WINDOW w AS (PARTITION BY station_id)),
ll AS (SELECT a.station_id, a.nb_id, {S2} * exp(-a.x * a.x - a.y * a.y) AS k1, {S2} * exp(-b.x * b.x - b.y * b.y) AS k2, {S2} * exp(-pow(a.x - b.x, 2) - pow(a.y - b.y, 2)) AS k12 FROM xy a JOIN xy b ON a.station_id = b.station_id AND a.nb_id <> b.nb_id)
SELECT station_id, nb_id, round(0.5 + (k1 - k2) / (2 * ({S2} + {T2} - k12)), 6) + 0.0 AS w FROM ll""")(lambda s, d: rounded(learned.latent_kriging(_edges(s, d).where("rank <= 2"), ["dist", "rank"], X_NET, Y_NET), "w"))

# Kernel neighbours: stations whose ids are divisible by 3 are asked for, the others train

SCALED = "sqrt(pow((a.lat - b.lat) / 0.5::DOUBLE, 2) + pow((a.lon - b.lon) / 2::DOUBLE, 2))"
KERNEL = f"""kr AS (SELECT a.station_id, b.station_id AS nb_id, CAST(row_number() OVER (PARTITION BY a.station_id ORDER BY {SCALED}, b.station_id) AS INT) AS rank, 1.5 * exp(-pow({SCALED}, 2) / 2) AS cov FROM stations a JOIN stations b ON a.station_id % 3 = 0 AND b.station_id % 3 <> 0)"""
query("kernel_knn", "stations", f", {KERNEL} SELECT station_id, nb_id, rank, round(cov, 6) + 0.0 AS cov FROM kr WHERE rank <= 6")(
    lambda s, d: rounded(learned.kernel_knn(V.stations(s, d).where("station_id % 3 = 0"), V.stations(s, d).where("station_id % 3 <> 0"), 6, 1.5, (0.5, 2.0)), "cov")
)
query("nngpr_predict", "stations", f""", {KERNEL}, st AS (SELECT avg(elevation) AS m, stddev_pop(elevation) AS sd FROM stations WHERE station_id % 3 <> 0), k2 AS (SELECT station_id, max(CASE WHEN rank = 1 THEN nb_id END) AS n1, max(CASE WHEN rank = 2 THEN nb_id END) AS n2, max(CASE WHEN rank = 1 THEN cov END) AS c1, max(CASE WHEN rank = 2 THEN cov END) AS c2 FROM kr WHERE rank <= 2 GROUP BY ALL),
kk AS (SELECT k2.*, 1.5 * exp(-pow({SCALED}, 2) / 2) AS c12, (a.elevation - m) / sd AS y1, (b.elevation - m) / sd AS y2, m, sd, 1.5 + 0.01 AS c FROM k2 JOIN stations a ON a.station_id = n1 JOIN stations b ON b.station_id = n2, st),
bb AS (SELECT *, (c * c1 - c12 * c2) / (c * c - c12 * c12) AS b1, (c * c2 - c12 * c1) / (c * c - c12 * c12) AS b2 FROM kk)
SELECT station_id, round(m + sd * (b1 * y1 + b2 * y2), 4) + 0.0 AS mean, round(sd * sqrt(greatest(1.5 - b1 * c1 - b2 * c2, 0)), 4) + 0.0 AS sd FROM bb""")(
    lambda s, d: rounded(learned.nngpr_predict(V.stations(s, d).where("station_id % 3 <> 0").withColumn("value", F.col("elevation")), V.stations(s, d).where("station_id % 3 = 0"), 2, 1.5, (0.5, 2.0), 0.01), "mean", "sd", digits=4)
)
query("nngpr_predict_many")(lambda s, d: rounded(learned.nngpr_predict(V.stations(s, d).withColumn("value", F.col("elevation")), V.stations(s, d), 12, 1.5, (0.5, 2.0), 0.01, exclude_same=True), "mean", "sd"))
