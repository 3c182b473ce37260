"""Further registered queries: samples, features, smoothing, gates, tiles, lines and plain geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import clean, evaluate, graph, interp, joins, raster, samples, timeseries
from . import queries as Q
from . import views as V
from .queries import HAVERSINE, query, rounded

N, I, D = "stations nb", "stations nb series idw", "stations edges"


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


# Time and samples

query("normalize_time", "", "SELECT event_id, ts - INTERVAL 7 HOUR AS ts FROM events")(lambda s, d: samples.normalize_time(_events(s, d).select("event_id", "ts"), "ts", "+07:00"))
query("to_float32", "", "SELECT event_id, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) + 0.0 AS value FROM events")(lambda s, d: rounded(samples.to_float32(_events(s, d).select("event_id", "value"), "value").withColumn("value", F.col("value").cast("double")), "value", digits=3))
query("coverage_check", "stations", "SELECT count(*) FILTER (WHERE NOT (lon BETWEEN 3.9 AND 4.1 AND lat BETWEEN 50.4 AND 50.6)) AS outside, count(*) AS total FROM stations")(lambda s, d: samples.coverage_check(V.stations(s, d), (3.9, 50.4, 4.1, 50.6)))
query("hours_between", "", "SELECT event_id, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) / 3600) AS BIGINT) AS hours FROM events")(
    lambda s, d: _events(s, d).select("event_id", S.hours_between(F.col("ts").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("hours"))
)
RAIN = "rain AS (SELECT user_id AS station_id, date_trunc('day', ts)::TIMESTAMP AS ts, CAST(count(*) AS DOUBLE) AS rain FROM events WHERE event_type <> 'click' GROUP BY ALL)"


def _rain(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).where("event_type <> 'click'")
    return e.groupBy(F.col("user_id").alias("station_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("rain"))


query("align_series", "readings", f", {RAIN} SELECT station_id, ts, value, rain FROM readings JOIN rain USING (station_id, ts)")(lambda s, d: samples.align_series(V.readings(s, d), _rain(s, d)))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    weeks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.struct(w.alias("week_idx"), F.slice(F.col("embedding").cast("array<double>"), w * 8 + 1, F.lit(8)).alias("values")))
    return e.select(F.col("vec_id").cast("long").alias("station_id"), F.explode(weeks).alias("w")).select("station_id", "w.week_idx", "w.values")


def _even(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).where((F.col("week_idx") + F.col("station_id")) % 3 != 0).select("station_id", "week_idx")


query("flatten_segments", "series", "SELECT station_id, CAST(row_number() OVER (PARTITION BY station_id ORDER BY pos) - 1 AS BIGINT) AS pos, round(value, 6) + 0.0 AS value FROM series WHERE (pos // 8 + station_id) % 3 <> 0")(
    lambda s, d: rounded(samples.flatten_segments(_chunks(s, d), _even(s, d)), "value")
)
query("sample_week", "readings weeks", """SELECT station_id, week_idx FROM (SELECT *, count(*) OVER (PARTITION BY station_id) AS n,
row_number() OVER (PARTITION BY station_id ORDER BY md5('s1:' || station_id || ':' || week_idx)) AS nth FROM weeks) WHERE nth = 1 AND n >= 2""")(lambda s, d: samples.sample_week(Q.weeks(s, d), "s1", 2))
query("random_split", "stations", """SELECT station_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'valid' ELSE 'train' END AS role
FROM (SELECT station_id, CAST(CAST('0x' || substr(md5('s1:' || station_id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM stations)""")(lambda s, d: samples.random_split(V.stations(s, d).select("station_id"), "station_id", 0.1, 0.2, "s1"))
query("split_by_cluster")(lambda s, d: samples.split_by_cluster(V.stations(s, d), Q.neighbors(s, d), 25, 13, 1))
query("neighbor_features", N, f"""SELECT f.station_id, nb_id, round(dist, 6) AS dist, round(sign(lat2 - lat) * ({HAVERSINE.replace("lon2 - lon", "0.0")}), 6) + 0.0 AS dx,
round(sign(lon2 - lon) * ({HAVERSINE.replace("lat2 - lat", "0.0").replace("radians(lat2)", "radians(lat)")}), 6) + 0.0 AS dy, round(z2 - z1, 6) + 0.0 AS dz, CAST(sign(z2 - z1) AS INT) AS dir, width1, width2, lat AS lat1, lon AS lon1, lat2, lon2
FROM (SELECT nb.station_id, nb_id, dist, a.lat, a.lon, a.elevation AS z1, a.width AS width1, b.lat AS lat2, b.lon AS lon2, b.elevation AS z2, b.width AS width2
FROM nb JOIN stations a ON a.station_id = nb.station_id JOIN stations b ON b.station_id = nb_id) f""")(lambda s, d: rounded(samples.neighbor_features(Q.neighbors(s, d), V.stations(s, d)), "dist", "dx", "dy", "dz"))
query("edge_attr_normalize", N, """SELECT station_id, nb_id, round(CASE WHEN k <> -10 THEN 1 / (k / max(CASE WHEN k <> -10 THEN abs(k) END) OVER w + 1e-8) ELSE k END, 5) + 0.0 AS k,
round(CASE WHEN k <> -10 THEN 1 / (dist / max(CASE WHEN k <> -10 THEN abs(dist) END) OVER w + 1e-8) ELSE dist END, 5) + 0.0 AS dist
FROM (SELECT station_id, nb_id, CASE WHEN rank = 3 THEN -10.0 ELSE CAST(rank AS DOUBLE) END AS k, dist FROM nb) WINDOW w AS (PARTITION BY station_id)""")(
    lambda s, d: rounded(samples.edge_attr_normalize(Q.neighbors(s, d).select("station_id", "nb_id", F.when(F.col("rank") == 3, -10.0).otherwise(F.col("rank").cast("double")).alias("k"), "dist"), "station_id", ["k", "dist"]), "k", "dist", digits=5)
)
query("build_samples", N + " series", "SELECT nb.station_id, t.pos, nb.rank, round(t.value, 6) + 0.0 AS target, round(s.value, 6) + 0.0 AS value, round(nb.dist, 6) AS dist FROM nb JOIN series s ON s.station_id = nb_id JOIN series t ON t.station_id = nb.station_id AND t.pos = s.pos")(
    lambda s, d: rounded(samples.build_samples(Q.neighbors(s, d), V.series(s, d)), "target", "value", "dist")
)
query("node_table", "stations series", """, n AS (SELECT station_id AS node FROM stations UNION SELECT -station_id - 1 FROM stations), p AS (SELECT DISTINCT pos FROM series)
SELECT n.node, p.pos, round(coalesce(s.value, 0.0), 6) + 0.0 AS value, round(coalesce(t.elevation, 0.0), 6) + 0.0 AS elevation, round(coalesce(t.width, 0.0), 6) AS width, s.value IS NOT NULL AS has_series
FROM n CROSS JOIN p LEFT JOIN series s ON s.station_id = n.node AND s.pos = p.pos LEFT JOIN stations t ON t.station_id = n.node""")(
    lambda s, d: rounded(samples.node_table(V.stations(s, d).select(F.explode(F.array(F.col("station_id"), -F.col("station_id") - 1)).alias("node")), V.stations(s, d).select("station_id", "elevation", "width"), V.series(s, d)), "value", "elevation", "width")
)
query("kernel_knn", N, """SELECT station_id, nb_id, CAST(r AS INT) AS rank, round(c, 6) AS cov FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY c DESC, nb_id) AS r
FROM (SELECT nb.station_id, nb_id, exp(-pow(dist, 2) / 0.5 - pow((b.elevation - a.elevation) / 20, 2)) AS c FROM nb JOIN stations a ON a.station_id = nb.station_id JOIN stations b ON b.station_id = nb_id)) WHERE r <= 3""")(
    lambda s, d: rounded(samples.kernel_knn(_with_elevation(s, d), F.exp(-F.pow("dist", F.lit(2)) / 0.5 - F.pow((F.col("z2") - F.col("z1")) / 20, F.lit(2))), 3), "cov")
)


def _with_elevation(s: SparkSession, d: str) -> DataFrame:
    st = V.stations(s, d)
    return Q.neighbors(s, d).join(st.select("station_id", F.col("elevation").alias("z1")), "station_id").join(st.select(F.col("station_id").alias("nb_id"), F.col("elevation").alias("z2")), "nb_id")


TILED = "tile AS (SELECT station_id, CAST(floor(lat * 10) AS BIGINT) || '_' || CAST(floor(lon * 10) AS BIGINT) AS tile FROM stations), paths AS (SELECT nb.station_id, nb_id, tile FROM nb JOIN tile USING (station_id) UNION SELECT nb.station_id, nb_id, tile FROM nb JOIN tile ON tile.station_id = nb_id)"


def _tiles(s: SparkSession, d: str) -> DataFrame:
    part = lambda c: F.floor(F.col(c) * 10).cast("long").cast("string")
    return V.stations(s, d).select("station_id", F.concat_ws("_", part("lat"), part("lon")).alias("tile"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    nb, t = Q.neighbors(s, d).select("station_id", "nb_id"), _tiles(s, d)
    return nb.join(t, "station_id").union(nb.join(t.withColumnRenamed("station_id", "nb_id"), "nb_id").select("station_id", "nb_id", "tile")).distinct()


query("tile_allow", N, f", {TILED}, ok AS (SELECT tile FROM tile GROUP BY ALL HAVING count(*) >= 4) SELECT station_id, nb_id FROM paths GROUP BY ALL HAVING bool_and(tile IN (SELECT tile FROM ok)) AND count(DISTINCT tile) <= 1")(
    lambda s, d: samples.tile_allow(_paths(s, d), _tiles(s, d).groupBy("tile").count().where("count >= 4"), 1)
)
query("group_by_tile_set", N, f", {TILED}, g AS (SELECT station_id, nb_id, string_agg(DISTINCT tile, ',' ORDER BY tile) AS tiles FROM paths GROUP BY ALL) SELECT tiles, count(*) AS n FROM g GROUP BY ALL")(lambda s, d: samples.group_by_tile_set(_paths(s, d)))
query("first_elevation", N, "SELECT nb.station_id, round(min_by(b.elevation, rank), 6) + 0.0 AS elevation FROM nb JOIN stations b ON b.station_id = nb_id WHERE b.elevation > 0 GROUP BY ALL")(
    lambda s, d: rounded(samples.first_elevation(Q.neighbors(s, d), _with_elevation(s, d).select("station_id", "nb_id", F.when(F.col("z2") > 0, F.col("z2")).alias("elevation"))), "elevation")
)
query("distinct_widths", "stations", "SELECT DISTINCT round(width, 1) AS width FROM stations")(lambda s, d: samples.distinct_widths(V.stations(s, d).select(F.round("width", 1).alias("width"))))
query("width_stats", "stations edges", """SELECT e.src AS station_id, CAST(e.src % 5 AS BIGINT) AS nb_id, round(avg(b.width), 6) AS mean, round(stddev_pop(b.width), 6) AS std, round(min(b.width), 6) AS min, round(max(b.width), 6) AS max, round(median(b.width), 6) AS median,
round(sum(CASE WHEN b.elevation >= 0 THEN km ELSE 0 END), 6) AS forward_km, round(sum(CASE WHEN b.elevation < 0 THEN km ELSE 0 END), 6) AS backward_km FROM edges e JOIN stations b ON b.station_id = e.dst GROUP BY ALL""")(
    lambda s, d: rounded(
        samples.width_stats(Q.edges(s, d).join(V.stations(s, d).withColumnRenamed("station_id", "dst"), "dst").select(F.col("src").alias("station_id"), (F.col("src") % 5).alias("nb_id"), F.col("rank").alias("seq"), "width", "km", F.when(F.col("elevation") >= 0, 1).otherwise(-1).alias("dir"))),
        "mean", "std", "min", "max", "median", "forward_km", "backward_km",
    )
)
query("order_by_coord_sum", "stations", "SELECT station_id, CAST(row_number() OVER (ORDER BY lat + lon, station_id) - 1 AS BIGINT) AS ord FROM stations")(lambda s, d: joins.order_by_coord_sum(V.stations(s, d)))

# Smoothing, gates, groups

query("sliding_windows", "series", "SELECT station_id, CAST(w AS INT) AS win, round(avg(value), 6) + 0.0 AS mean, count(*) AS n FROM series, range(0, 7) r(w) WHERE pos BETWEEN w * 8 AND w * 8 + 15 GROUP BY ALL")(
    lambda s, d: rounded(timeseries.sliding_windows(V.series(s, d), 16, 8).groupBy("station_id", "win").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")), "mean")
)
# 64 places, 15 %: a window of 9, half of it 4
SAVGOL = """sg AS (SELECT a.station_id, a.pos, a.value, least(greatest(a.pos - 4, 0), 55) AS st FROM series a),
sm AS (SELECT a.station_id, a.pos, any_value(a.value) AS value, any_value(a.pos - a.st - 4) AS v, sum(b.value) AS y0, sum((b.pos - a.st - 4) * b.value) AS y1, sum(pow(b.pos - a.st - 4, 2) * b.value) AS y2
FROM sg a JOIN series b ON b.station_id = a.station_id AND b.pos BETWEEN a.st AND a.st + 8 GROUP BY a.station_id, a.pos),
tr AS (SELECT station_id, pos, value, (y0 - (9 * y2 - 60 * y0) / (9 * 708 - 3600) * 60) / 9 + y1 / 60 * v + (9 * y2 - 60 * y0) / (9 * 708 - 3600) * v * v AS trend FROM sm)"""
query("savgol_trend", "series", f", {SAVGOL} SELECT station_id, pos, round(trend, 6) + 0.0 AS trend FROM tr")(lambda s, d: rounded(timeseries.savgol_trend(V.series(s, d)), "trend"))
query("fluctuation_score", "series", f""", {SAVGOL}, rr AS (SELECT *, value - trend AS rest FROM tr),
wh AS (SELECT station_id, sum(rest * rest) / sum(value * value) AS energy, stddev_pop(rest) AS sd FROM rr GROUP BY ALL),
wi AS (SELECT station_id, w, pos, rest, CAST(sign(rest) <> sign(lag(rest) OVER (PARTITION BY station_id, w ORDER BY pos)) AS INT) AS crossed FROM rr, range(0, 7) r(w) WHERE pos BETWEEN w * 8 AND w * 8 + 15),
wg AS (SELECT station_id, w, sum(coalesce(crossed, 0)) / 15.0 AS rate, stddev_pop(rest) AS own FROM wi GROUP BY ALL)
SELECT wg.station_id, round(0.5 * any_value(energy) + 0.5 * avg(CASE WHEN rate > 0.1 AND own > 0.5 * sd THEN 1.0 ELSE 0 END), 6) AS score FROM wg JOIN wh ON wh.station_id = wg.station_id GROUP BY wg.station_id""")(lambda s, d: rounded(timeseries.fluctuation_score(V.series(s, d)), "score"))
query("gated_loss", "predictions", "SELECT method, round(sum((station_id % 7 + 1) / 7.0 * pow(out - tgt, 2)) / sum((station_id % 7 + 1) / 7.0), 6) AS loss FROM predictions GROUP BY ALL")(
    lambda s, d: rounded(timeseries.gated_loss(V.predictions(s, d), V.predictions(s, d).select("station_id").distinct().withColumn("gate", (F.col("station_id") % 7 + 1) / 7)), "loss")
)
query("masked_mse", "predictions", "SELECT method, round(avg(mse), 6) AS mse FROM (SELECT method, station_id, avg(pow(out - tgt, 2)) AS mse FROM predictions WHERE pos % 3 <> 0 GROUP BY ALL) GROUP BY ALL")(
    lambda s, d: rounded(evaluate.masked_mse(V.predictions(s, d).withColumn("mask", (F.col("pos") % 3 == 0).cast("int"))), "mse")
)
query("fir_table", "series", "SELECT a.station_id, a.pos, round(sum((b.pos - a.pos + 4) / (4.0 * (1 + a.pos % 3)) * b.value), 6) + 0.0 AS value FROM series a JOIN series b ON b.station_id = a.station_id AND b.pos BETWEEN a.pos - 3 AND a.pos GROUP BY ALL")(
    lambda s, d: rounded(timeseries.fir_table(V.series(s, d), V.series(s, d).select("station_id", "pos", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: k / (4.0 * (1 + F.col("pos") % 3))).alias("w"))), "value")
)
query("dry_neighbor_index", N + " series", """, t AS (SELECT station_id, sum(value) AS total FROM series GROUP BY ALL)
SELECT nb.station_id, CAST(coalesce(min(CASE WHEN total < 0.01 THEN rank END) - 1, count(*)) AS BIGINT) AS wet FROM nb JOIN t ON t.station_id = nb_id GROUP BY ALL""")(lambda s, d: samples.dry_neighbor_index(Q.neighbors(s, d), V.series(s, d)))
query("group_consensus", N + " series", """, both_ AS (SELECT x.station_id, x.nb_id AS a, y.nb_id AS b FROM nb x JOIN nb y ON x.station_id = y.station_id AND x.nb_id <> y.nb_id),
c AS (SELECT p.a, p.b, abs(corr(u.value, v.value)) AS c FROM (SELECT DISTINCT a, b FROM both_) p JOIN series u ON u.station_id = p.a JOIN series v ON v.station_id = p.b AND v.pos = u.pos GROUP BY ALL),
m AS (SELECT station_id, a AS nb_id, avg(c) AS mean FROM both_ JOIN c USING (a, b) GROUP BY ALL)
SELECT station_id, nb_id, round((mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w), 5) AS consensus FROM m WINDOW w AS (PARTITION BY station_id)""")(lambda s, d: rounded(samples.group_consensus(V.series(s, d), Q.neighbors(s, d)), "consensus", digits=5))
query("station_gate", I, """, r AS (SELECT i.station_id, i.pos, i.out, s.value AS raw FROM idw i JOIN series s ON s.station_id = i.station_id AND s.pos = i.pos),
g AS (SELECT station_id, 1 / (1 + exp(-10 * (covar_pop(out, raw) / (stddev_pop(out) * stddev_pop(raw)) - 0.5))) AS g FROM r GROUP BY ALL)
SELECT r.station_id, pos, round(g * out + (1 - g) * raw, 6) + 0.0 AS value FROM r JOIN g ON g.station_id = r.station_id""")(
    lambda s, d: rounded(samples.station_gate(interp.weights_apply(interp.idw_weights(Q.neighbors(s, d)), V.series(s, d)).join(V.series(s, d).withColumnRenamed("value", "raw"), ["station_id", "pos"])), "value")
)
query("overall", "predictions", """SELECT method, round(sum(mse * n) / sum(n), 6) AS mse, round(avg(corr), 6) AS corr FROM (SELECT method, station_id, avg(pow(out - tgt, 2)) AS mse, count(*) AS n,
covar_pop(tgt, out) / (stddev_pop(tgt) * stddev_pop(out) + 1e-8) AS corr FROM predictions GROUP BY ALL) GROUP BY ALL""")(lambda s, d: rounded(evaluate.overall(V.predictions(s, d)), "mse", "corr"))
query("best_row", "predictions", "SELECT station_id, round(rmse, 6) AS rmse FROM (SELECT station_id, sqrt(avg(pow(out - tgt, 2))) AS rmse FROM predictions GROUP BY ALL) ORDER BY rmse, station_id LIMIT 1")(
    lambda s, d: rounded(evaluate.best_row(V.predictions(s, d).groupBy("station_id").agg(F.sqrt(F.avg(F.pow(F.col("out") - F.col("tgt"), F.lit(2)))).alias("rmse")), "rmse", "station_id"), "rmse")
)
query("paired_ttest_p")(lambda s, d: rounded(evaluate.paired_ttest_p(V.predictions(s, d), "a", "b"), "mean", "sd", "t", "p"))
query("adjust_p_bonferroni", "predictions", f", {Q.TESTS} SELECT test, p, round(least(1.0, p * count(*) OVER ()), 6) AS p_adj FROM t")(lambda s, d: rounded(evaluate.adjust_p(Q.TESTED(s, d), "bonferroni"), "p_adj"))

# Rasters

query("affine_cell", "stations", "SELECT station_id, CAST(floor((lat - 51.5) / -0.01) AS INT) AS row, CAST(floor((lon - 3.0) / 0.01) AS INT) AS col FROM stations")(lambda s, d: raster.affine_to_cell(V.stations(s, d), 3.0, 51.5, 0.01, -0.01).select("station_id", "row", "col"))
query("cell_to_gps", "cells", "SELECT row, col, round(3.0 + (col + 0.5) * 0.01, 6) AS lon, round(51.5 + (row + 0.5) * -0.01, 6) AS lat FROM cells")(lambda s, d: rounded(raster.cell_to_gps(V.cells(s, d).select("row", "col"), 3.0, 51.5, 0.01, -0.01), "lon", "lat"))
query("gps_to_cell", "stations", "SELECT station_id, CAST(trunc((lat - 51.5) / (49.5 - 51.5) * 200) AS INT) AS row, CAST(trunc((lon - 3.0) / (5.0 - 3.0) * 100) AS INT) AS col FROM stations")(lambda s, d: raster.gps_to_cell(V.stations(s, d), 51.5, 3.0, 49.5, 5.0, 200, 100).select("station_id", "row", "col"))


def _two_tiles(s: SparkSession, d: str) -> DataFrame:
    c = V.cells(s, d)
    return c.where("row % 40 < 24").withColumn("tile", F.lit("a")).union(c.where("row % 40 >= 16").select("row", "col", (F.col("z") * 2).alias("z")).withColumn("tile", F.lit("b")))


TWO = "two AS (SELECT row, col, z, 'a' AS tile FROM cells WHERE row % 40 < 24 UNION ALL SELECT row, col, z * 2, 'b' FROM cells WHERE row % 40 >= 16)"
query("merge_tiles", "cells", f", {TWO} SELECT row, col, round(min_by(z, tile), 6) + 0.0 AS z FROM two GROUP BY ALL")(lambda s, d: rounded(raster.merge_tiles(_two_tiles(s, d)), "z"))
query("mosaic", "cells", f", {TWO}, m AS (SELECT tile, CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, avg(z) AS z FROM two GROUP BY tile, row // 4, col // 4) SELECT row, col, round(max_by(z, tile), 6) + 0.0 AS z FROM m GROUP BY ALL")(lambda s, d: rounded(raster.mosaic(_two_tiles(s, d), 4), "z"))
query("raster_lookup", "stations cells", "SELECT station_id, round(z, 6) + 0.0 AS z FROM (SELECT station_id, CAST(station_id AS INT) AS row, CAST(floor((lon - 3.0) * 40) AS INT) AS col FROM stations) p LEFT JOIN cells c ON c.row = p.row AND c.col = p.col")(
    lambda s, d: rounded(joins.raster_lookup(V.stations(s, d).select("station_id", F.col("station_id").cast("int").alias("row"), F.floor((F.col("lon") - 3.0) * 40).cast("int").alias("col")), V.cells(s, d)).select("station_id", "z"), "z")
)
query("cost_surface", "cells", "SELECT row, col, round(CASE WHEN z < 0.1 THEN pow(z / 4, 2) ELSE pow(z, 2) END, 6) AS cost FROM cells")(lambda s, d: rounded(raster.cost_surface(V.cells(s, d), 0.1), "cost"))
LINE = "ln AS (SELECT station_id AS id, CAST(station_id AS INT) AS r0, 0 AS c0, CAST(station_id + station_id % 9 AS INT) AS r1, CAST(10 + station_id % 50 AS INT) AS c1 FROM stations), ls AS (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0), 1) AS n FROM ln), lc AS (SELECT id, CAST(k AS INT) AS seq, CAST(floor(r0 + (r1 - r0) * k / n + 0.5) AS INT) AS row, CAST(floor(c0 + (c1 - c0) * k / n + 0.5) AS INT) AS col FROM (SELECT *, unnest(range(n + 1)) AS k FROM ls))"


def _grid_lines(s: SparkSession, d: str) -> DataFrame:
    i = F.col("station_id")
    return raster.line_cells(V.stations(s, d).select(i.alias("id"), i.cast("int").alias("r0"), F.lit(0).alias("c0"), (i + i % 9).cast("int").alias("r1"), (10 + i % 50).cast("int").alias("c1")))


query("line_cells", "stations", f", {LINE} SELECT * FROM lc")(_grid_lines)
query("sample_along", "stations cells", f", {LINE} SELECT id, seq, round(z, 6) + 0.0 AS z FROM lc JOIN cells c ON c.row = lc.row AND c.col = lc.col")(lambda s, d: rounded(raster.sample_along(_grid_lines(s, d), V.cells(s, d)), "z"))
PROFILE = ["mean", "std", "min", "max", "median", "slope", "dz"]
query("edge_profile", "stations cells", f""", {LINE}, al AS (SELECT id, seq, z, abs(z) AS slope FROM lc LEFT JOIN cells c ON c.row = lc.row AND c.col = lc.col)
SELECT id, {", ".join(f"round(coalesce({x}, -1), 6) + 0.0 AS {n}" for n, x in zip(PROFILE, ["avg(z)", "stddev_pop(z)", "min(z)", "max(z)", "median(z)", "avg(slope)", "max_by(z, seq) FILTER (WHERE z IS NOT NULL) - min_by(z, seq) FILTER (WHERE z IS NOT NULL)"]))} FROM al GROUP BY ALL""")(
    lambda s, d: rounded(raster.edge_profile(_grid_lines(s, d), V.cells(s, d), V.cells(s, d).select("row", "col", F.abs("z").alias("slope"))), *PROFILE)
)

# Geometry

query("displacement", N, "SELECT nb.station_id, nb_id, round(b.lat - a.lat, 6) + 0.0 AS dlat, round(b.lon - a.lon, 6) + 0.0 AS dlon, round(abs(a.lat - b.lat) + abs(a.lon - b.lon), 6) AS l1, round(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2), 6) AS sq_l2, round(sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2)), 6) AS euclid FROM nb JOIN stations a ON a.station_id = nb.station_id JOIN stations b ON b.station_id = nb_id")(
    lambda s, d: rounded(_pairs(s, d).select("station_id", "nb_id", (F.col("lat2") - F.col("lat1")).alias("dlat"), (F.col("lon2") - F.col("lon1")).alias("dlon"), *[f(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))).alias(f.__name__) for f in (S.l1, S.sq_l2, S.euclid)]), "dlat", "dlon", "l1", "sq_l2", "euclid")
)


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return samples.neighbor_features(Q.neighbors(s, d), V.stations(s, d))


query("ecef", "stations", "SELECT station_id, round(6371.0 * cos(radians(lat)) * cos(radians(lon)), 6) AS x, round(6371.0 * cos(radians(lat)) * sin(radians(lon)), 6) + 0.0 AS y, round(6371.0 * sin(radians(lat)), 6) AS z FROM stations")(
    lambda s, d: rounded(V.stations(s, d).select("station_id", S.ecef(F.col("lat"), F.col("lon")).alias("e")).select("station_id", "e.*"), "x", "y", "z")
)


def _bit_sql(chars: int) -> str:
    n, out = chars * 5, []
    for c in range(chars):
        bits = [f"((({'y' if p % 2 else 'x'} >> {n // 2 - 1 - p // 2 if p % 2 else (n + 1) // 2 - 1 - p // 2}) & 1) * {1 << (5 * c + 4 - p)})" for p in range(5 * c, 5 * c + 5)]
        out.append(f"substr('{S.BASE32}', CAST({' + '.join(bits)} + 1 AS BIGINT), 1)")
    return " || ".join(out)


query("geohash12", "stations", f"SELECT station_id, {_bit_sql(12)} AS geohash FROM (SELECT station_id, CAST(floor((lon + 180) / 360 * {2**30}) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * {2**30}) AS BIGINT) AS y FROM stations)")(
    lambda s, d: V.stations(s, d).select("station_id", S.geohash(F.col("lat"), F.col("lon")).alias("geohash"))
)
query("meters_to_degrees", "stations", "SELECT station_id, round(1000 / 6371000.0 * 180 / pi(), 9) AS lat, round(1000 / 6371000.0 * 180 / pi() / cos(radians(lat)), 9) AS lon FROM stations")(
    lambda s, d: rounded(V.stations(s, d).select("station_id", S.meters_to_degrees(F.lit(1000.0), F.col("lat")).alias("m")).select("station_id", "m.*"), "lat", "lon", digits=9)
)
query("order_latlon", "stations", "SELECT station_id, lat, lon FROM stations")(
    lambda s, d: clean.order_latlon(V.stations(s, d).select("station_id", F.when(F.col("station_id") % 2 == 0, F.col("lat")).otherwise(F.col("lon")).alias("a"), F.when(F.col("station_id") % 2 == 0, F.col("lon")).otherwise(F.col("lat")).alias("b")), "a", "b", (45.0, 56.0), (0.0, 10.0)).select("station_id", "lat", "lon")
)
XYZ = lambda p: f"[6371.0 * cos(radians({p}lat)) * cos(radians({p}lon)), 6371.0 * cos(radians({p}lat)) * sin(radians({p}lon)), 6371.0 * sin(radians({p}lat))]"
query("line_within", "stations", f""", v AS (SELECT o_custkey AS line_id, o_orderkey, 50 + (o_orderkey % 1000) / 1000.0 AS lat, 4 + (o_orderkey % 777) / 777.0 AS lon FROM orders),
w AS (SELECT line_id, {XYZ("")} AS a, lead({XYZ("")}) OVER (PARTITION BY line_id ORDER BY o_orderkey) AS b FROM v),
g AS (SELECT station_id, line_id, p, a, [b[1] - a[1], b[2] - a[2], b[3] - a[3]] AS ab, [p[1] - a[1], p[2] - a[2], p[3] - a[3]] AS ap FROM (SELECT station_id, {XYZ("")} AS p FROM stations), w WHERE b IS NOT NULL),
t AS (SELECT station_id, line_id, ab, ap, greatest(0.0, least(1.0, coalesce(list_dot_product(ap, ab) / nullif(list_dot_product(ab, ab), 0), 0.0))) AS t FROM g),
k AS (SELECT station_id, line_id, sqrt(pow(ap[1] - t * ab[1], 2) + pow(ap[2] - t * ab[2], 2) + pow(ap[3] - t * ab[3], 2)) AS km FROM t)
SELECT s.station_id, m.line_id, round(m.km, 5) AS km FROM stations s LEFT JOIN (SELECT station_id, min(line_id) AS line_id, min(km) AS km FROM (SELECT *, min(km) OVER (PARTITION BY station_id) AS least_km FROM k WHERE km <= 1.0) WHERE km = least_km GROUP BY ALL) m USING (station_id)""")(
    lambda s, d: rounded(joins.line_within(V.stations(s, d), _segments(s, d), 1.0), "km", digits=5)
)


def _segments(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("line_id").orderBy("seq")
    v = Q._lines(s, d).select("line_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"))
    return v.where("lat2 is not null")


query("on_path_edges", D, """, h AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS hops UNION SELECT e.src, h.hops + 1 FROM h JOIN edges e ON e.dst = h.node WHERE h.hops < 200), m AS (SELECT node, min(hops) AS hops FROM h GROUP BY ALL)
SELECT src, dst FROM edges e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst WHERE a.hops = b.hops + 1""")(lambda s, d: _on_path(s, d))


def _on_path(s: SparkSession, d: str) -> DataFrame:
    e = Q.edges(s, d)
    return graph.on_path_edges(e, Q.stored(graph.hops_to_target(e, 0), "hops"))
