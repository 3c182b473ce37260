"""Registered queries of Gaussian processes, least squares, paths, nearest lines and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, gaussian, interp, learned, paths
from . import more as M
from . import queries as Q
from . import views as V
from .queries import query, rounded

THETA = (1.0, 0.1, 3.0)
GRID = [(1.0, 0.1, 1.0), (1.0, 0.1, 3.0), (2.0, 0.1, 3.0), (1.0, 0.5, 3.0)]


def _between(a: str, b: str) -> str:
    return f"sqrt(pow({a}.lat - {b}.lat, 2) + pow({a}.lon - {b}.lon, 2))"


def _factors_sql(links: str, grid=(THETA,)) -> str:
    """Two neighbours (links: src, dst, rank), whose system is solved by its determinant."""
    rows = ", ".join(str(t) for t in grid)
    return f"""g AS (SELECT s2::DOUBLE AS s2, tau::DOUBLE AS tau, phi::DOUBLE AS phi, s2::DOUBLE * (1 + tau::DOUBLE) AS c0 FROM (VALUES {rows}) g(s2, tau, phi)),
vv AS (SELECT station_id, elevation / 100 AS v, width AS x FROM stations),
pr AS (SELECT src, max(CASE WHEN rank = 1 THEN dst END) AS n1, max(CASE WHEN rank = 2 THEN dst END) AS n2 FROM ({links}) GROUP BY src),
pc AS (SELECT s.station_id, n1, n2, g.*, s2 * exp(-phi * {_between("s", "a")}) AS c1, s2 * exp(-phi * {_between("s", "b")}) AS c2, s2 * exp(-phi * {_between("a", "b")}) AS c12
FROM g CROSS JOIN stations s LEFT JOIN pr ON pr.src = s.station_id LEFT JOIN stations a ON a.station_id = n1 LEFT JOIN stations b ON b.station_id = n2),
pb AS (SELECT *, CASE WHEN n2 IS NULL THEN c1 / c0 ELSE (c0 * c1 - c12 * c2) / (c0 * c0 - c12 * c12) END AS b1, CASE WHEN n2 IS NOT NULL THEN (c0 * c2 - c12 * c1) / (c0 * c0 - c12 * c12) END AS b2 FROM pc),
vf AS (SELECT *, c0 - coalesce(b1 * c1, 0) - coalesce(b2 * c2, 0) AS f FROM pb),
vd AS (SELECT vf.*, v.v AS v, (v.v - coalesce(b1 * v1.v, 0) - coalesce(b2 * v2.v, 0)) / sqrt(f) AS d, (1 - coalesce(b1, 0) - coalesce(b2, 0)) / sqrt(f) AS d1, (v.x - coalesce(b1 * v1.x, 0) - coalesce(b2 * v2.x, 0)) / sqrt(f) AS dx,
coalesce(b1 * v1.v, 0) + coalesce(b2 * v2.v, 0) AS mean FROM vf JOIN vv v ON v.station_id = vf.station_id LEFT JOIN vv v1 ON v1.station_id = n1 LEFT JOIN vv v2 ON v2.station_id = n2)"""


BEFORE, AROUND = "SELECT src, dst, rank FROM edges WHERE rank <= 2", "SELECT station_id AS src, nb_id AS dst, rank FROM nb WHERE rank <= 2"


def _values(s: SparkSession, d: str) -> DataFrame:
    return V.stations(s, d).select("station_id", (F.col("elevation") / 100).alias("value"), F.lit(1.0).alias("one"), "width")


def _before(s: SparkSession, d: str) -> DataFrame:
    return Q.edges(s, d).where("rank <= 2").select(F.col("src").alias("station_id"), F.col("dst").alias("nb_id"), "rank")


def _vecchia(s: SparkSession, d: str) -> DataFrame:
    return Q.stored(gaussian.vecchia_factors(V.stations(s, d), _before(s, d), THETA), "vecchia")


# Gaussian processes

query("vecchia_factors", "stations edges", f", {_factors_sql(BEFORE)} SELECT station_id, round(f, 6) AS f, round(coalesce(b1, 0) + coalesce(b2, 0), 6) + 0.0 AS b_sum FROM vf")(
    lambda s, d: rounded(_vecchia(s, d).select("station_id", "f", F.aggregate("b", F.lit(0.0), lambda a, x: a + x).alias("b_sum")), "f", "b_sum")
)
query("decorrelate", "stations edges", f", {_factors_sql(BEFORE)} SELECT station_id, round(d, 6) + 0.0 AS value FROM vd")(lambda s, d: rounded(gaussian.decorrelate(_values(s, d).select("station_id", "value"), _vecchia(s, d), "value"), "value"))
query("vecchia_loglik", "stations edges", f", {_factors_sql(BEFORE)} SELECT round(sum(ln(f) + d * d), 4) AS loss FROM vd")(lambda s, d: rounded(gaussian.vecchia_loglik(_values(s, d).select("station_id", "value"), _vecchia(s, d)), "loss", digits=4))
query("theta_search", "stations edges", f", {_factors_sql(BEFORE, GRID)} SELECT s2 AS sigma2, tau, phi, round(sum(ln(f) + d * d), 4) AS loss FROM vd GROUP BY ALL")(
    lambda s, d: rounded(gaussian.theta_search(_values(s, d).select("station_id", "value"), V.stations(s, d), _before(s, d), GRID), "loss", digits=4)
)
query("krige_predict_ci", "stations nb", f", {_factors_sql(AROUND)} SELECT station_id, round(mean, 6) + 0.0 AS mean, round(mean - 1.96 * sqrt(greatest(f, 0)), 6) AS low, round(mean + 1.96 * sqrt(greatest(f, 0)), 6) AS high FROM vd")(
    lambda s, d: rounded(gaussian.krige_predict_ci(V.stations(s, d), Q.neighbors(s, d).where("rank <= 2"), V.stations(s, d), _values(s, d), THETA), "mean", "low", "high")
)
query("linear_gls", "stations edges", f""", {_factors_sql(BEFORE)}, m AS (SELECT sum(d1 * d1) AS a, sum(d1 * dx) AS b, sum(dx * dx) AS c, sum(d1 * d) AS p, sum(dx * d) AS q, sum(d * d) AS r, count(*) AS n FROM vd),
k AS (SELECT *, (c * p - b * q) / (a * c - b * b) AS k0, (a * q - b * p) / (a * c - b * b) AS k1 FROM m), v AS (SELECT *, (r - k0 * p - k1 * q) / (n - 2) / (a * c - b * b) AS s FROM k)
SELECT 'one' AS feature, round(k0, 5) + 0.0 AS coef, round(s * c, 5) AS variance FROM v UNION ALL SELECT 'width', round(k1, 5) + 0.0, round(s * a, 5) FROM v""")(
    lambda s, d: rounded(gaussian.linear_gls(_values(s, d), _vecchia(s, d), "value", ["one", "width"]), "coef", "variance", digits=5)
)
DRAWS = [[0.5, 0.1], [0.4, 0.12], [0.7, 0.07], [0.55, 0.11], [0.3, 0.13], [0.6, 0.09]]
ROW = "[" + ", ".join(f"{a} + {b} * width" for a, b in DRAWS) + "]"
query("coef_interval", "stations", f"SELECT station_id, round(list_aggregate({ROW}::DOUBLE[], 'quantile_cont', 0.1), 6) AS low, round(list_aggregate({ROW}::DOUBLE[], 'quantile_cont', 0.9), 6) AS high FROM stations")(
    lambda s, d: rounded(gaussian.coef_interval(_values(s, d), ["one", "width"], DRAWS, 0.1).select("station_id", "low", "high"), "low", "high")
)
NNGP = """xs AS (SELECT s.station_id, s.pos, s.value, t.elevation FROM series s JOIN stations t USING (station_id)), be AS (SELECT regr_slope(value, elevation) AS k, regr_intercept(value, elevation) AS i FROM xs),
re AS (SELECT station_id, pos, i + k * elevation AS trend, value - i - k * elevation AS r FROM xs, be), la AS (SELECT *, lag(r) OVER (PARTITION BY station_id ORDER BY pos) AS p FROM re),
ph AS (SELECT sum(r * p) / sum(p * p) AS phi, count(*) AS n, sum(r * r) AS rr, sum(r * p) AS rp, sum(p * p) AS pp FROM la WHERE p IS NOT NULL)"""


def _trended(s: SparkSession, d: str) -> DataFrame:
    return V.series(s, d).join(V.stations(s, d).select("station_id", "elevation"), "station_id").withColumn("one", F.lit(1.0))


@query("nngp_fit", "stations series", f", {NNGP} SELECT round(i, 6) + 0.0 AS constant, round(k, 6) + 0.0 AS slope, round(phi, 6) + 0.0 AS phi, round((rr - 2 * phi * rp + phi * phi * pp) / n, 6) AS variance FROM be, ph")
def _nngp_fit(s: SparkSession, d: str) -> DataFrame:
    fit = gaussian.nngp_fit(_trended(s, d), ["one", "elevation"])
    return rounded(s.createDataFrame([(*fit["beta"], fit["phi"], fit["variance"])], "constant double, slope double, phi double, variance double"), "constant", "slope", "phi", "variance")


NNGP_WEIGHTS = f"""{NNGP}, va AS (SELECT phi, (rr - 2 * phi * rp + phi * phi * pp) / n AS v FROM ph), nn AS (SELECT nb.station_id, nb_id, rank, dist, s.lon AS x, s.lat AS y FROM nb JOIN stations s ON s.station_id = nb_id),
ce AS (SELECT station_id, avg(x) AS mx, avg(y) AS my FROM nn GROUP BY ALL), ra AS (SELECT station_id, median(sqrt(pow(x - mx, 2) + pow(y - my, 2))) + 1e-12 AS r FROM nn JOIN ce USING (station_id) GROUP BY ALL),
tw AS (SELECT a.station_id, a.nb_id AS n1, b.nb_id AS n2, v, 0.8::DOUBLE * v * exp(-a.dist / r) AS c1, 0.8::DOUBLE * v * exp(-b.dist / r) AS c2, 0.8::DOUBLE * v * exp(-sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / r) AS c12 FROM nn a JOIN nn b ON b.station_id = a.station_id AND a.rank = 1 AND b.rank = 2 JOIN ra ON ra.station_id = a.station_id, va),
wk AS (SELECT *, 0.5 + (c1 - c2) / (2 * (v + 1e-8 - c12)) AS w1 FROM tw), wn AS (SELECT station_id, n1 AS nb_id, w1 AS w, v - w1 * c1 - (1 - w1) * c2 + c1 - w1 * (v + 1e-8) - (1 - w1) * c12 AS variance FROM wk UNION ALL SELECT station_id, n2, 1 - w1, v - w1 * c1 - (1 - w1) * c2 + c1 - w1 * (v + 1e-8) - (1 - w1) * c12 FROM wk)"""


def _nngp(s: SparkSession, d: str, m: int) -> tuple[DataFrame, dict, DataFrame]:
    x = _trended(s, d)
    fit = gaussian.nngp_fit(x, ["one", "elevation"])
    w = learned.nngp_weights(Q.neighbors(s, d), V.stations(s, d), fit["sigma2"], fit["tau2"], fit["ell"], m)
    return x, fit, Q.stored(w, "nngp-weights")


query("nngp_weights", "stations nb series", f", {NNGP_WEIGHTS} SELECT station_id, nb_id, round(w, 6) + 0.0 AS w, round(greatest(variance, 1e-12), 6) + 0.0 AS variance FROM wn")(lambda s, d: rounded(_nngp(s, d, 2)[2], "w", "variance"))


@query("nngp_predict", "stations nb series", f""", {NNGP_WEIGHTS}, ii AS (SELECT la.station_id, pos, r - coalesce(p, 0) * phi AS e FROM la, ph), uu AS (SELECT w.station_id, pos, sum(w.w * e) AS u FROM wn w JOIN ii ON ii.station_id = w.nb_id GROUP BY ALL)
SELECT a.station_id, CAST(a.pos AS BIGINT) AS pos, round(any_value(r.trend) + sum(pow((SELECT phi FROM ph), a.pos - b.pos) * b.u), 6) + 0.0 AS out FROM uu a JOIN uu b ON b.station_id = a.station_id AND b.pos <= a.pos JOIN re r ON r.station_id = a.station_id AND r.pos = a.pos GROUP BY ALL""")
def _nngp_predict(s: SparkSession, d: str) -> DataFrame:
    x, fit, w = _nngp(s, d, 2)
    return rounded(gaussian.nngp_predict(x, w.select("station_id", "nb_id", "w"), fit), "out")


@query("nngp_predict_many")
def _nngp_many(s: SparkSession, d: str) -> DataFrame:
    x, fit, w = _nngp(s, d, 10)
    return rounded(gaussian.nngp_predict(x, w.select("station_id", "nb_id", "w"), fit), "out")


query("rain_response")(lambda s, d: rounded(gaussian.rain_response(V.series(s, d).join(V.rain(s, d).withColumnRenamed("value", "rain"), ["station_id", "pos"]), "value", "rain"), "coef"))
query("oracle_weights")(lambda s, d: rounded(gaussian.oracle_weights(Q.neighbors(s, d), V.series(s, d)), "w"))
for _name, _drift in (("kriging_linear", False), ("universal_kriging", True)):
    query(_name)(lambda s, d, drift=_drift: rounded(interp.weights_apply(interp.linear_variogram_kriging(Q.neighbors(s, d), V.stations(s, d), V.series(s, d), drift), V.series(s, d)), "out"))

# Paths: pairs are each station and its neighbours, paths of at most three hops

HOPS = """rh AS (SELECT station_id AS root, station_id AS node, 0 AS hops FROM stations UNION SELECT root, e.dst, hops + 1 FROM rh JOIN edges e ON e.src = rh.node WHERE hops < 3), rm AS (SELECT root, node, min(hops) AS hops FROM rh GROUP BY ALL),
tp AS (SELECT r.root, r.node, min(q.node) AS parent FROM rm r JOIN edges e ON e.dst = r.node JOIN rm q ON q.root = r.root AND q.node = e.src AND q.hops = r.hops - 1 GROUP BY r.root, r.node),
pa AS (SELECT nb_id AS a, station_id AS b FROM nb), f1 AS (SELECT a, b, 1 AS dir, root, node, hops FROM pa JOIN rm ON root = a AND node = b),
f2 AS (SELECT a, b, -1 AS dir, root, node, hops FROM pa JOIN rm ON root = b AND node = a WHERE (a, b) NOT IN (SELECT (a, b) FROM f1)),
tr AS (SELECT a, b, dir, root, node, hops AS seq FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2) UNION ALL SELECT a, b, dir, tr.root, tp.parent, seq - 1 FROM tr JOIN tp ON tp.root = tr.root AND tp.node = tr.node)"""
PN = "stations nb edges"


def _ends(s: SparkSession, d: str) -> DataFrame:
    return Q.neighbors(s, d).select(F.col("nb_id").alias("a"), F.col("station_id").alias("b"))


query("reachability", PN, f", {HOPS} SELECT a, b, x.hops AS there, y.hops AS back FROM pa LEFT JOIN rm x ON x.root = a AND x.node = b LEFT JOIN rm y ON y.root = b AND y.node = a")(lambda s, d: paths.reachability(Q.edges(s, d), _ends(s, d), 3))
query("shortest_hop_paths", PN, f", {HOPS} SELECT a, b, dir, seq, node FROM tr")(lambda s, d: paths.shortest_hop_paths(Q.edges(s, d), _ends(s, d), 3))


@query("simplify_graph", PN, f""", {HOPS}, p0 AS (SELECT b AS station_id, a AS nb_id, seq, node, seq = max(seq) OVER (PARTITION BY a, b) AS last FROM tr WHERE dir = 1),
mt AS (SELECT x.station_id, x.nb_id, min(x.seq) AS seq, min_by(x.node, x.seq) AS node FROM p0 x JOIN p0 y ON y.station_id = x.station_id AND y.node = x.node AND y.nb_id > x.nb_id AND NOT y.last GROUP BY x.station_id, x.nb_id, y.nb_id),
pl AS (SELECT station_id, nb_id, seq, node FROM mt UNION SELECT station_id, nb_id, seq, node FROM p0 WHERE seq = 0 OR last),
ch AS (SELECT *, lead(node) OVER (PARTITION BY station_id, nb_id ORDER BY seq) AS dst FROM pl)
SELECT DISTINCT station_id, node AS src, dst, 1 AS flag FROM ch WHERE dst <> node UNION SELECT station_id, nb_id, station_id, -1 FROM nb WHERE (station_id, nb_id) NOT IN (SELECT (station_id, nb_id) FROM p0)""")
def _simplified(s: SparkSession, d: str) -> DataFrame:
    nb = Q.neighbors(s, d)
    p = Q.stored(paths.shortest_hop_paths(Q.edges(s, d), nb.select(F.col("nb_id").alias("a"), F.col("station_id").alias("b")), 3), "simplify-paths")
    return paths.simplify_graph(p.where("dir = 1").select(F.col("b").alias("station_id"), F.col("a").alias("nb_id"), "seq", "node"), nb.select("station_id", "nb_id"))


@query("path_cells", "stations", """SELECT path_id, part, CAST(k AS INT) AS seq, CAST(floor(r0 + (r1 - r0) * k / n + 0.5) AS INT) AS row, CAST(floor(c0 + (c1 - c0) * k / n + 0.5) AS INT) AS col FROM (
SELECT station_id AS path_id, 1 AS part, station_id AS r0, 0 AS c0, station_id + station_id % 9 AS r1, 10 + station_id % 7 AS c1, greatest(station_id % 9, 10 + station_id % 7) AS n FROM stations
UNION ALL SELECT station_id, 2, station_id + station_id % 9, 10 + station_id % 7, station_id + 3, 40, greatest(abs(station_id % 9 - 3), 30 - station_id % 7) FROM stations), range(0, 64) r(k) WHERE k <= n""")
def _path_cells(s: SparkSession, d: str) -> DataFrame:
    i = F.col("station_id")
    at = lambda seq, row, col: F.struct(F.lit(seq).alias("seq"), row.cast("int").alias("row"), col.cast("int").alias("col"))
    nodes = F.array(at(0, i, F.lit(0)), at(1, i + i % 9, 10 + i % 7), at(2, i + 3, F.lit(40)))
    return paths.path_cells(V.stations(s, d).select(i.alias("path_id"), F.explode(nodes).alias("n")).select("path_id", "n.*"))


def _km_sql(p: str, a: str, b: str) -> str:
    """Distance of p from segment ab, all of them lists of x, y, z."""
    ab, ap = (f"[{x}[1] - {a}[1], {x}[2] - {a}[2], {x}[3] - {a}[3]]" for x in (b, p))
    t = f"greatest(0.0, least(1.0, coalesce(list_dot_product({ap}, {ab}) / nullif(list_dot_product({ab}, {ab}), 0), 0.0)))"
    return "sqrt(" + " + ".join(f"pow({p}[{i}] - {a}[{i}] - {t} * ({b}[{i}] - {a}[{i}]), 2)" for i in (1, 2, 3)) + ")"


query("snap_to_graph", "stations edges", f""", q AS (SELECT station_id, lat + 0.013 AS lat, lon - 0.007 AS lon FROM stations),
kn AS (SELECT q.station_id, b.station_id AS nid FROM q CROSS JOIN stations b QUALIFY row_number() OVER (PARTITION BY q.station_id ORDER BY {_between("q", "b")}, b.station_id) <= 10),
cd AS (SELECT DISTINCT station_id, src, dst FROM kn JOIN edges ON src = nid OR dst = nid),
cx AS (SELECT c.station_id, src, dst, {M.XYZ("q.")} AS p, {M.XYZ("a.")} AS a, {M.XYZ("b.")} AS b, CASE WHEN {_between("q", "a")} <= {_between("q", "b")} THEN src ELSE dst END AS node FROM cd c JOIN q USING (station_id) JOIN stations a ON a.station_id = src JOIN stations b ON b.station_id = dst)
SELECT station_id, round(min({_km_sql("p", "a", "b")}), 5) AS km FROM cx GROUP BY ALL""")(
    lambda s, d: rounded(paths.snap_to_graph(V.stations(s, d).select("station_id", (F.col("lat") + 0.013).alias("lat"), (F.col("lon") - 0.007).alias("lon")), V.stations(s, d), Q.edges(s, d)).select("station_id", "km"), "km", digits=5)
)
LINES = f"""vs AS (SELECT o_custkey AS line_id, o_orderkey, 50 + (o_orderkey % 1000) / 1000.0 AS lat, 4 + (o_orderkey % 777) / 777.0 AS lon FROM orders),
ws AS (SELECT line_id, {M.XYZ("")} AS a, lead({M.XYZ("")}) OVER (PARTITION BY line_id ORDER BY o_orderkey) AS b FROM vs),
gs AS (SELECT station_id, line_id, {_km_sql("p", "a", "b")} AS km FROM (SELECT station_id, {M.XYZ("")} AS p FROM stations), ws WHERE b IS NOT NULL)"""
query("nearest_line", "stations", f", {LINES} SELECT station_id, round(min(km), 5) AS km FROM gs GROUP BY ALL")(lambda s, d: rounded(paths.nearest_line(V.stations(s, d), M._segments(s, d)).select("station_id", "km"), "km", digits=5))
query("dist_to_lines", "stations", f", {LINES} SELECT station_id, round(min(km) * 1000, 2) AS m, round(min(km), 5) AS km, round(min(km) / 100, 6) AS km100 FROM gs GROUP BY ALL")(
    lambda s, d: rounded(rounded(rounded(paths.dist_to_lines(V.stations(s, d), M._segments(s, d)), "m", digits=2), "km", digits=5), "km100")
)
query("expand_region", "cells", """, ok AS (SELECT row, col FROM cells WHERE z > -0.05), ex AS (SELECT row, col, 0 AS i FROM cells WHERE z > 0.25 UNION SELECT ok.row, ok.col, i + 1 FROM ex JOIN ok ON abs(ok.row - ex.row) + abs(ok.col - ex.col) = 1 WHERE i < 3)
SELECT DISTINCT row, col FROM ex""")(lambda s, d: paths.expand_region(V.cells(s, d).where("z > 0.25"), V.cells(s, d).where("z > -0.05"), 3))

# Peaks and bins

query("bin_errors_best_ref", "predictions bins", """, hit AS (SELECT station_id, pos FROM predictions WHERE method = 'a' AND abs(out - tgt) <= 0.2)
SELECT method, bin, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, count(*) AS n FROM bins WHERE bin IS NOT NULL AND (station_id, pos) IN (SELECT (station_id, pos) FROM hit) GROUP BY ALL HAVING count(*) >= 20""")(
    lambda s, d: rounded(evaluate.bin_errors_best_ref(V.predictions(s, d), "a", 0.2, 20), "mean", "std")
)
query("find_peaks")(lambda s, d: evaluate.find_peaks(V.series(s, d), 0.1, 0.05, 6))
query("peak_metrics")(lambda s, d: rounded(evaluate.peak_metrics(V.series(s, d), interp.weights_apply(interp.idw_weights(Q.neighbors(s, d)), V.series(s, d)).withColumnRenamed("out", "value"), height=0.1, prominence=0.02, distance=6), "recall", "mae", "false_rate"))
