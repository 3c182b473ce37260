"""Registered queries: each applies an operator to the whole of its tables; SQL says the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean, evaluate, graph, interp, joins, raster, timeseries
from ..operators.supersteps import stored
from ..sources import sensors
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DAY = 86400
PLANAR = "sqrt(pow(a.lat - b.lat, 2) + pow(a.lon - b.lon, 2))"
PARTS = V.SQL | {
    "nb": f"nb AS (SELECT a.station_id, b.station_id AS nb_id, CAST(row_number() OVER (PARTITION BY a.station_id ORDER BY {PLANAR}, b.station_id) AS INT) AS rank, {PLANAR} AS dist FROM stations a JOIN stations b ON a.station_id <> b.station_id QUALIFY row_number() OVER (PARTITION BY a.station_id ORDER BY {PLANAR}, b.station_id) <= 5)",
    "edges": f"edges AS (SELECT a.station_id AS src, b.station_id AS dst, CAST(row_number() OVER (PARTITION BY a.station_id ORDER BY {PLANAR}, b.station_id) AS INT) AS rank, {PLANAR} AS km FROM stations a JOIN stations b ON b.station_id < a.station_id QUALIFY row_number() OVER (PARTITION BY a.station_id ORDER BY {PLANAR}, b.station_id) <= 3)",
    "runs": "lagged AS (SELECT *, date_diff('second', lag(ts) OVER (PARTITION BY station_id ORDER BY ts), ts) AS delta FROM readings), runs AS (SELECT *, CAST(coalesce(sum(CASE WHEN delta <> 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id ORDER BY ts), 0) AS INT) AS run FROM lagged)",
    "weeks": "weeks AS (SELECT DISTINCT station_id, CAST(floor(date_diff('second', (SELECT min(ts) FROM readings), ts) / 604800) AS INT) AS week_idx FROM readings)",
    "idw": "a AS (SELECT *, pow(greatest(dist, 1e-12), -2) AS a FROM nb), w AS (SELECT station_id, nb_id, a / (sum(a) OVER (PARTITION BY station_id) + 1e-12) AS w FROM a), idw AS (SELECT w.station_id, s.pos, sum(w.w * s.value) AS out FROM w JOIN series s ON s.station_id = w.nb_id GROUP BY ALL)",
    "bins": "bins AS (SELECT *, abs(out - tgt) AS e, CASE WHEN abs(tgt) <= 0.3 THEN 'low' WHEN abs(tgt) > 0.3 AND abs(tgt) < 0.6 THEN 'mid' WHEN abs(tgt) >= 0.6 AND abs(tgt) < 1.2 THEN 'high' END AS bin FROM predictions WHERE abs(tgt) < 4)",
    "pairs": "pairs AS (SELECT x.station_id, x.pos, x.bin, x.e AS ea, y.e AS eb FROM bins x JOIN bins y USING (station_id, pos) WHERE x.method = 'a' AND y.method = 'b' AND x.bin IS NOT NULL)",
    "med": "med AS (SELECT station_id, median(value) AS med FROM series GROUP BY ALL), dev AS (SELECT s.*, abs(value - med) AS d FROM series s JOIN med USING (station_id))",
}


def with_(names: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(PARTS[n] for n in names.split()) + "\n" + body


def query(name: str, parts: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_(parts, sql) if parts else sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in cols})


def neighbors(spark, d, k: int = 5) -> DataFrame:
    return stored(joins.knn_self(V.stations(spark, d), k), "neighbors")


def edges(spark, d) -> DataFrame:
    return stored(joins.knn_predecessors(V.stations(spark, d), 3).select(F.col("station_id").alias("src"), F.col("nb_id").alias("dst"), "rank", F.col("dist").alias("km")), "edges")


def weeks(spark, d) -> DataFrame:
    r = V.readings(spark, d)
    origin = r.agg(F.min(F.unix_timestamp("ts")).alias("o"))
    return r.join(F.broadcast(origin)).select("station_id", F.floor((F.unix_timestamp("ts") - F.col("o")) / (7 * DAY)).cast("int").alias("week_idx")).distinct()  # origin: one row


def scored(spark, d) -> DataFrame:
    s = V.series(spark, d)
    return interp.score(interp.weights_apply(interp.idw_weights(neighbors(spark, d)), s), s, "idw")


# Interpolation

query("knn_self", "stations nb", "SELECT station_id, nb_id, rank, round(dist, 6) AS dist FROM nb")(lambda s, d: rounded(neighbors(s, d), "dist"))
query("knn_predecessors", "stations edges", "SELECT src, dst, rank, round(km, 6) AS km FROM edges")(lambda s, d: rounded(edges(s, d), "km"))
query("idw_power", "stations nb series idw", "SELECT station_id, pos, round(out, 6) + 0.0 AS out FROM idw")(lambda s, d: rounded(interp.weights_apply(interp.idw_weights(neighbors(s, d)), V.series(s, d)), "out"))
query("idw_pearson", "stations nb series idw", """SELECT station_id, round(covar_pop(value, out) / (stddev_pop(value) * stddev_pop(out) + 1e-8), 6) + 0.0 AS corr, round(avg(pow(out - value, 2)), 6) + 0.0 AS mse, count(*) AS n
FROM idw JOIN series USING (station_id, pos) GROUP BY station_id""")(lambda s, d: rounded(evaluate.pearson(scored(s, d), ["station_id"]), "corr", "mse"))
query("idw_river", "stations nb series", """, a AS (SELECT *, 1 / (CASE WHEN rank = 5 THEN 9999.0 ELSE greatest(dist, 1e-12) END) AS a FROM nb)
SELECT station_id, nb_id, round(a / (sum(a) OVER (PARTITION BY station_id) + 1e-8), 6) AS w FROM a""")(lambda s, d: rounded(interp.idw_river(neighbors(s, d).withColumn("dist", F.when(F.col("rank") == 5, -1.0).otherwise(F.col("dist")))), "w"))
query("ordinary_kriging")(lambda s, d: rounded(interp.interpolate(neighbors(s, d), V.stations(s, d), V.series(s, d), "ordinary_kriging"), "out"))
query("kriging_external_drift")(lambda s, d: rounded(interp.interpolate(neighbors(s, d, 8), V.stations(s, d), V.series(s, d), "ked"), "out"))
query("rbf_thin_plate")(lambda s, d: rounded(interp.interpolate(neighbors(s, d, 8), V.stations(s, d), V.series(s, d), "rbf_thin_plate"), "out"))
query("sparsemax", "stations nb", """, r AS (SELECT station_id, nb_id, -dist AS s, row_number() OVER w AS k, sum(-dist) OVER w AS c FROM nb WINDOW w AS (PARTITION BY station_id ORDER BY -dist DESC, nb_id)),
t AS (SELECT station_id, max_by((c - 1) / k, k) AS tau FROM r WHERE 1 + k * s > c GROUP BY ALL)
SELECT station_id, nb_id, round(greatest(s - tau, 0), 6) + 0.0 AS p FROM r JOIN t USING (station_id)""")(lambda s, d: rounded(interp.sparsemax(neighbors(s, d).withColumn("s", -F.col("dist"))), "p"))
query("consensus", "stations nb series", """, c AS (SELECT nb.station_id, nb.nb_id, corr(a.value, b.value) AS c FROM nb JOIN series a ON a.station_id = nb.station_id JOIN series b ON b.station_id = nb.nb_id AND a.pos = b.pos GROUP BY ALL)
SELECT station_id, round(avg(abs(c)), 6) AS consensus FROM c GROUP BY ALL""")(lambda s, d: rounded(interp.consensus(V.series(s, d), neighbors(s, d)), "consensus"))
query("pair_covariance", "stations nb", "SELECT station_id AS a, nb_id AS b, round(2.0 * exp(-3 * dist / 4.0), 6) AS cov FROM nb")(lambda s, d: rounded(interp.pair_covariance(neighbors(s, d).select(F.col("station_id").alias("a"), F.col("nb_id").alias("b"), "dist"), 2.0, 0.1, 4.0).drop("dist"), "cov"))
query("coord_basis", "stations", """, e AS (SELECT min(lat) a, max(lat) b, min(lon) c, max(lon) d FROM stations), s AS (SELECT station_id, (lat - a) / (b - a) AS y, (lon - c) / (d - c) AS x FROM stations, e),
k AS (SELECT '4:' || i || ':' || j AS knot, i / 1.0 AS kx, j / 1.0 AS ky, 2.5 / 2 AS theta FROM range(2) t(i), range(2) u(j) UNION ALL SELECT '16:' || i || ':' || j, i / 3.0, j / 3.0, 2.5 / 4 FROM range(4) t(i), range(4) u(j)),
g AS (SELECT station_id, knot, sqrt(pow(x - kx, 2) + pow(y - ky, 2)) / theta AS d FROM s, k)
SELECT station_id, knot, round(pow(1 - d, 6) * (35 * d * d + 18 * d + 3) / 3, 6) AS value FROM g WHERE d <= 1""")(lambda s, d: rounded(interp.coord_basis(V.stations(s, d)), "value"))
query("residual_correct", "stations nb series idw", """, p AS (SELECT station_id, pos, value AS tgt, out FROM idw JOIN series USING (station_id, pos)), m AS (SELECT w.station_id, p.pos, sum(w.w * (p.tgt - p.out)) AS more FROM w JOIN p ON p.station_id = w.nb_id GROUP BY ALL)
SELECT station_id, pos, round(out + coalesce(more, 0), 6) + 0.0 AS out FROM p LEFT JOIN m USING (station_id, pos)""")(lambda s, d: rounded(interp.residual_correct(scored(s, d).withColumn("pos", F.col("pos").cast("int")), interp.idw_weights(neighbors(s, d))), "out"))
query("normalize_coords", "stations nb", """, g AS (SELECT nb.station_id, nb_id, lon AS x, lat AS y FROM nb JOIN stations s ON s.station_id = nb_id), c AS (SELECT station_id, nb_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM g WINDOW w AS (PARTITION BY station_id)),
r AS (SELECT station_id, median(sqrt(x * x + y * y)) AS r FROM c GROUP BY ALL)
SELECT station_id, nb_id, round(x / r, 6) + 0.0 AS x, round(y / r, 6) + 0.0 AS y FROM c JOIN r USING (station_id)""")(lambda s, d: rounded(interp.normalize_coords(neighbors(s, d).join(V.stations(s, d).select(F.col("station_id").alias("nb_id"), F.col("lon").alias("x"), F.col("lat").alias("y")), "nb_id").select("station_id", "nb_id", "x", "y")), "x", "y"))

# Time series

query("gap_report", "readings", """, g AS (SELECT station_id, lag(ts) OVER w AS gap_from, ts AS gap_to, date_diff('second', lag(ts) OVER w, ts) AS gap_s FROM readings WINDOW w AS (PARTITION BY station_id ORDER BY ts))
SELECT station_id, strftime(gap_from, '%Y-%m-%d') AS gap_from, strftime(gap_to, '%Y-%m-%d') AS gap_to, gap_s FROM g WHERE gap_s <> 86400""")(lambda s, d: timeseries.gap_report(V.readings(s, d), DAY).withColumns({"gap_from": F.date_format("gap_from", "yyyy-MM-dd"), "gap_to": F.date_format("gap_to", "yyyy-MM-dd")}))
query("resample_daily", "readings", """, c AS (SELECT station_id, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS DATE) AS day FROM readings GROUP BY station_id)
SELECT c.station_id, CAST(c.day AS VARCHAR) AS day, round(avg(value), 6) AS value FROM c LEFT JOIN readings r ON r.station_id = c.station_id AND CAST(r.ts AS DATE) = c.day GROUP BY ALL""")(lambda s, d: rounded(timeseries.resample_daily(V.readings(s, d)), "value").withColumn("day", F.col("day").cast("string")))
query("full_months", "readings", """, s AS (SELECT station_id, min(CAST(ts AS DATE)) AS start FROM readings GROUP BY ALL)
SELECT r.station_id, strftime(r.ts, '%Y-%m-%d') AS day, r.value FROM readings r JOIN s USING (station_id) WHERE s.start <= date_trunc('month', r.ts)""")(lambda s, d: timeseries.full_months(V.readings(s, d)).select("station_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"))
query("contiguous_runs", "readings runs", "SELECT station_id, run, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, count(*) AS n FROM runs GROUP BY station_id, run")(lambda s, d: timeseries.run_lengths(V.readings(s, d), DAY).withColumns({"first": F.date_format("first", "yyyy-MM-dd"), "last": F.date_format("last", "yyyy-MM-dd")}))
query("weekly_segments", "readings runs", """, o AS (SELECT min(ts) AS origin FROM readings), k AS (SELECT r.*, CAST(floor(date_diff('second', origin, ts) / 604800) AS INT) AS week_idx, origin, max(ts) OVER (PARTITION BY station_id, run) AS last FROM runs r, o)
SELECT station_id, week_idx, array_to_string(list(CAST(CAST(round(value * 10000) AS BIGINT) AS VARCHAR) ORDER BY ts), ',') AS values FROM k GROUP BY station_id, run, week_idx, origin, last
HAVING count(*) = 7 AND date_add(origin, INTERVAL 7 DAY * (week_idx + 1)) <= last""")(lambda s, d: timeseries.weekly_segments(V.readings(s, d), DAY).withColumn("values", F.array_join(F.transform("values", lambda x: F.round(x * 10000).cast("long").cast("string")), ",")))
query("trailing_mean", "series", "SELECT station_id, pos, round(avg(value) OVER (PARTITION BY station_id ORDER BY pos ROWS 4 PRECEDING), 6) + 0.0 AS value FROM series")(lambda s, d: rounded(timeseries.trailing_mean(V.series(s, d), 5), "value"))
query("lag_edgefill", "series", "SELECT station_id, pos, round(coalesce(lag(value, 3) OVER w, first_value(value) OVER w), 6) + 0.0 AS value FROM series WINDOW w AS (PARTITION BY station_id ORDER BY pos)")(lambda s, d: rounded(timeseries.lag_edgefill(V.series(s, d), 3), "value"))
query("window_mean_asym", "series", "SELECT station_id, pos, round(avg(value) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS value FROM series")(lambda s, d: rounded(timeseries.window_mean_asym(V.series(s, d), 5), "value"))
query("zscore", "series", "SELECT station_id, pos, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8), 6) + 0.0 AS value FROM series WINDOW w AS (PARTITION BY station_id)")(lambda s, d: rounded(timeseries.zscore(V.series(s, d)), "value"))
query("fixed_chunks", "series", "SELECT station_id, CAST(pos // 24 AS INT) AS chunk, pos % 24 AS pos, round(value, 6) + 0.0 AS value FROM series WHERE pos < 48")(lambda s, d: rounded(timeseries.fixed_chunks(V.series(s, d), 24), "value"))
query("day_chunks", "series", "SELECT station_id, CAST(pos // 24 AS INT) AS chunk, round(list_sum(list(value ORDER BY pos)), 6) + 0.0 AS total, count(*) AS n FROM series WHERE pos < 48 GROUP BY ALL")(lambda s, d: rounded(timeseries.day_chunks(V.series(s, d)).select("station_id", "chunk", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("values").cast("long").alias("n")), "total"))
query("time_varying_fir", "series", "SELECT station_id, pos, round(0.2 * coalesce(lag(value, 2) OVER w, 0) + 0.3 * coalesce(lag(value, 1) OVER w, 0) + 0.5 * value, 6) + 0.0 AS value FROM series WINDOW w AS (PARTITION BY station_id ORDER BY pos)")(lambda s, d: rounded(timeseries.time_varying_fir(V.series(s, d), [0.2, 0.3, 0.5]), "value"))
query("lagged_corr_gate", "series", """, w AS (SELECT * FROM series WHERE pos < 32), r AS (SELECT station_id, pos - 32 AS pos, value FROM series WHERE pos >= 32),
c AS (SELECT w.station_id, lag, count(*) AS n, corr(w.value, r.value) AS c FROM w JOIN (SELECT unnest(range(-24, 25)) AS lag) l ON true JOIN r ON r.station_id = w.station_id AND r.pos = w.pos + lag GROUP BY ALL HAVING count(*) >= 8),
b AS (SELECT station_id, max(abs(coalesce(c, 0))) AS best FROM c GROUP BY ALL)
SELECT station_id, round(best, 6) AS best, round(0.05 + 0.95 * pow(best, 2), 6) AS gate FROM b""")(lambda s, d: rounded(timeseries.lagged_corr_gate(V.series(s, d).where("pos < 32"), V.series(s, d).where("pos >= 32").withColumn("pos", F.col("pos") - 32)), "best", "gate"))

# Cleaning

query("center_by_median", "series med", "SELECT s.station_id, pos, round(value - med, 6) + 0.0 AS value FROM series s JOIN med USING (station_id)")(lambda s, d: rounded(clean.center_by_median(V.series(s, d)), "value"))
query("abs_deviation_range", "series med", "SELECT station_id, round(max(d) - min(d), 6) AS range FROM dev GROUP BY ALL")(lambda s, d: rounded(clean.abs_deviation_range(V.series(s, d)), "range"))
query("segment_quality", "series med", """, j AS (SELECT *, d - lag(d) OVER (PARTITION BY station_id ORDER BY pos) AS jump FROM dev)
SELECT station_id, round(avg(d), 6) AS mean_dev, round(max(jump), 6) AS max_jump FROM j GROUP BY ALL HAVING avg(d) < 4 AND max(jump) < 0.5""")(lambda s, d: rounded(clean.segment_quality(V.series(s, d)), "mean_dev", "max_jump"))
query("amplitude_filter", "series", "SELECT station_id, round(max(value) - min(value), 6) AS amplitude FROM series GROUP BY ALL HAVING max(value) - min(value) > 0.5 AND max(value) - min(value) < 4")(lambda s, d: rounded(clean.amplitude_filter(V.series(s, d), 0.5, 4.0), "amplitude"))
query("valid_mask", "series", "SELECT station_id, CAST(sum(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_valid FROM series GROUP BY ALL")(lambda s, d: clean.valid_mask(V.series(s, d)).groupBy("station_id").agg(F.sum(F.col("valid").cast("long")).alias("n_valid")))
query("significant_change", "series", """, f AS (SELECT *, list_sort([""" + ", ".join(f"coalesce({f} OVER w, 0)" for f in ("lag(value, 3)", "lag(value, 2)", "lag(value, 1)", "first_value(value)", "lead(value, 1)", "lead(value, 2)", "lead(value, 3)")).replace("first_value(value) OVER w", "lag(value, 0) OVER w") + """])[4] AS f FROM series WINDOW w AS (PARTITION BY station_id ORDER BY pos)),
r AS (SELECT *, value - f AS r, stddev_pop(value - f) OVER (PARTITION BY station_id) AS sd FROM f), v AS (SELECT station_id, CASE WHEN abs(r / (sd + 1e-8)) > 4 THEN f ELSE value END AS v FROM r)
SELECT station_id, round(max(v) - min(v), 6) AS span, max(v) - min(v) > 0.2 AS significant FROM v GROUP BY ALL""")(lambda s, d: rounded(clean.significant_change(V.series(s, d)), "span"))
query("spike_runs", "series med", """, mad AS (SELECT station_id, median(d) AS mad FROM dev GROUP BY ALL), z AS (SELECT dev.station_id, pos, pos - row_number() OVER (PARTITION BY dev.station_id ORDER BY pos) AS island FROM dev JOIN mad USING (station_id) WHERE d / (mad + 1e-8) > 2.5)
SELECT station_id, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS length FROM z GROUP BY station_id, island""")(lambda s, d: clean.spike_runs(V.series(s, d), 2.5))
query("suppress_spikes")(lambda s, d: rounded(clean.suppress_spikes(V.series(s, d), 2.5), "value"))
# Among stations with readings, the neighbours of one are the next two by id.
NEXT = "rn AS (SELECT a.station_id, b.station_id AS nb_id FROM (SELECT DISTINCT station_id FROM readings) a JOIN (SELECT DISTINCT station_id FROM readings) b ON b.station_id BETWEEN a.station_id + 1 AND a.station_id + 2)"


def next_stations(s: SparkSession, d: str) -> DataFrame:
    ids = V.readings(s, d).select("station_id").distinct()
    return ids.withColumn("nb_id", F.explode(F.array(F.col("station_id") + 1, F.col("station_id") + 2))).join(ids.select(F.col("station_id").alias("nb_id")), "nb_id", "left_semi").select("station_id", "nb_id")


query("eligible_stations", "readings weeks", f""", {NEXT}, r AS (SELECT station_id FROM weeks GROUP BY ALL HAVING count(*) >= 4)
SELECT station_id FROM r WHERE station_id IN (SELECT station_id FROM rn) AND station_id NOT IN (SELECT station_id FROM rn WHERE nb_id NOT IN (SELECT station_id FROM r))""")(lambda s, d: clean.eligible_stations(weeks(s, d), next_stations(s, d), 4))
query("bounds_of", "stations", "SELECT round(min(lon) - 0.5, 6) AS minlon, round(min(lat) - 0.5, 6) AS minlat, round(max(lon) + 0.5, 6) AS maxlon, round(max(lat) + 0.5, 6) AS maxlat FROM stations")(lambda s, d: rounded(clean.bounds_of(V.stations(s, d), 0.5), "minlon", "minlat", "maxlon", "maxlat"))
query("bbox_filter", "stations", "SELECT station_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM stations WHERE lon BETWEEN 3.9 AND 4.1 AND lat BETWEEN 50.4 AND 50.6")(lambda s, d: rounded(clean.bbox_filter(V.stations(s, d), (3.9, 50.4, 4.1, 50.6)).select("station_id", "lat", "lon"), "lat", "lon"))
query("time_slice", "readings", "SELECT station_id, strftime(ts, '%Y-%m-%d') AS day, value FROM readings WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")(lambda s, d: clean.time_slice(V.readings(s, d), "2024-01-08", 7).select("station_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"))
query("parse_sensor_lines", "", r"""WITH l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '# ' || event_id WHEN event_id % 7 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ';' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ';' || (event_id % 1000) || ',' || (10 + event_id % 90) END AS line FROM events)
SELECT split_part(line, ';', 1) AS ts_text, TRY_CAST(nullif(replace(split_part(line, ';', 2), ',', '.'), '') AS DOUBLE) AS value FROM l WHERE NOT starts_with(line, '#')""")(lambda s, d: sensors.parse_sensor_lines(s.read.parquet(f"{d}/events.parquet").select(
    F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("# "), F.col("event_id").cast("string")))
    .when(F.col("event_id") % 7 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(";")))
    .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(";"), (F.col("event_id") % 1000).cast("string"), F.lit(","), (10 + F.col("event_id") % 90).cast("string"))).alias("value"))).select("ts_text", "value"))

# Joins

query("common_weeks", "readings weeks", f""", {NEXT}, n AS (SELECT station_id, count(*) AS n FROM rn GROUP BY ALL), h AS (SELECT rn.station_id, week_idx, count(DISTINCT nb_id) AS m FROM rn JOIN weeks w ON w.station_id = rn.nb_id GROUP BY ALL)
SELECT station_id, week_idx FROM h JOIN n USING (station_id) WHERE m = n AND (station_id, week_idx) IN (SELECT (station_id, week_idx) FROM weeks)""")(lambda s, d: joins.common_weeks(weeks(s, d), next_stations(s, d)))
query("global_common_weeks", "readings weeks", "SELECT week_idx FROM weeks GROUP BY ALL HAVING count(DISTINCT station_id) = (SELECT count(DISTINCT station_id) FROM weeks)")(lambda s, d: joins.global_common_weeks(weeks(s, d)))
query("covering_stations", "readings weeks", "SELECT station_id FROM weeks WHERE week_idx IN (0, 1, 4) GROUP BY ALL HAVING count(DISTINCT week_idx) = 3")(lambda s, d: joins.covering_stations(weeks(s, d), s.createDataFrame([(0,), (1,), (4,)], "week_idx int")))
query("overlapping_stations", "readings weeks", "SELECT DISTINCT a.station_id FROM weeks a JOIN weeks b ON a.week_idx = b.week_idx AND a.station_id <> b.station_id")(lambda s, d: joins.overlapping_stations(weeks(s, d)))
query("entries_by_week", "readings weeks", "SELECT week_idx, array_to_string(list(station_id ORDER BY station_id), ',') AS stations FROM weeks GROUP BY ALL")(lambda s, d: joins.entries_by_week(weeks(s, d)).withColumn("stations", F.array_join(F.transform("stations", lambda x: x.cast("string")), ",")))
query("split_from_labels", "stations nb", """, t AS (SELECT station_id FROM stations WHERE cluster IN (1, 4, 7) UNION SELECT nb_id FROM nb WHERE station_id IN (SELECT station_id FROM stations WHERE cluster IN (1, 4, 7)))
SELECT station_id, CASE WHEN station_id IN (SELECT station_id FROM t) THEN 'train' ELSE 'test' END AS role FROM stations""")(lambda s, d: joins.split_from_labels(V.stations(s, d), neighbors(s, d), [1, 4, 7]))
query("subset_with_neighbors", "stations nb", "SELECT station_id FROM stations WHERE cluster = 2 UNION SELECT nb_id FROM nb WHERE station_id IN (SELECT station_id FROM stations WHERE cluster = 2)")(lambda s, d: joins.subset_with_neighbors(V.stations(s, d).where("cluster = 2"), neighbors(s, d)))
query("train_test_overlap", "stations", """, a AS (SELECT DISTINCT round(lat, 7) lat, round(lon, 7) lon FROM stations WHERE cluster < 6), b AS (SELECT DISTINCT round(lat, 7) lat, round(lon, 7) lon FROM stations WHERE cluster > 3)
SELECT CASE WHEN a.lat IS NULL THEN 'second' WHEN b.lat IS NULL THEN 'first' ELSE 'both' END AS side, count(*) AS n FROM a FULL JOIN b USING (lat, lon) GROUP BY ALL""")(lambda s, d: joins.train_test_overlap(V.stations(s, d).where("cluster < 6"), V.stations(s, d).where("cluster > 3")))
TILES = "tiles AS (SELECT 't' || lpad(CAST(i AS VARCHAR), 2, '0') AS tile, 3.4 + (i % 6) * 0.2 AS minlon, 49.9 + (i // 6) * 0.2 AS minlat, 3.4 + (i % 6) * 0.2 + 0.25 AS maxlon, 49.9 + (i // 6) * 0.2 + 0.25 AS maxlat FROM range(36) t(i))"
query("point_in_tile", "stations", f", {TILES} SELECT station_id, min(tile) AS tile FROM stations JOIN tiles ON lon BETWEEN minlon AND maxlon AND lat BETWEEN minlat AND maxlat GROUP BY ALL")(lambda s, d: joins.point_in_tile(V.stations(s, d), s.range(36).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("tile"), (3.4 + (F.col("id") % 6) * 0.2).alias("minlon"), (49.9 + F.floor(F.col("id") / 6) * 0.2).alias("minlat"), (3.4 + (F.col("id") % 6) * 0.2 + 0.25).alias("maxlon"), (49.9 + F.floor(F.col("id") / 6) * 0.2 + 0.25).alias("maxlat"))))
query("edge_lookup", "stations nb edges", """SELECT nb.station_id, nb.nb_id, round(coalesce(f.km, b.km, -1.0), 6) AS distance, CASE WHEN f.km IS NOT NULL THEN -1 WHEN b.km IS NOT NULL THEN 1 ELSE 0 END AS dir
FROM nb LEFT JOIN edges f ON f.src = nb.station_id AND f.dst = nb.nb_id LEFT JOIN edges b ON b.dst = nb.station_id AND b.src = nb.nb_id""")(lambda s, d: rounded(joins.edge_lookup(neighbors(s, d).select("station_id", "nb_id"), edges(s, d).withColumnRenamed("km", "distance")), "distance"))
query("align_methods", "predictions", "SELECT a.station_id, count(*) AS n, round(sum(a.out - b.out), 4) + 0.0 AS diff FROM predictions a JOIN predictions b USING (station_id, pos) WHERE a.method = 'a' AND b.method = 'b' GROUP BY ALL")(lambda s, d: rounded(joins.align_methods(V.predictions(s, d), "a", "b").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("out_a") - F.col("out_b")).alias("diff")), "diff", digits=4))

# Evaluation

query("pearson", "predictions", "SELECT method, station_id, round(covar_pop(tgt, out) / (stddev_pop(tgt) * stddev_pop(out) + 1e-8), 6) AS corr, round(avg(pow(out - tgt, 2)), 6) AS mse, count(*) AS n FROM predictions GROUP BY ALL")(lambda s, d: rounded(evaluate.pearson(V.predictions(s, d), ["method", "station_id"]), "corr", "mse"))
query("errors", "predictions", "SELECT method, round(sum(pow(out - tgt, 2)), 4) AS se, round(sum(tgt - out), 4) AS gain FROM predictions GROUP BY ALL")(lambda s, d: rounded(evaluate.errors(V.predictions(s, d)).groupBy("method").agg(F.sum("se").alias("se"), F.sum("gain").alias("gain")), "se", "gain", digits=4))
query("std_gap", "predictions", "SELECT method, station_id, round(abs(stddev_samp(tgt) - stddev_samp(out)), 6) AS std_gap FROM predictions GROUP BY ALL")(lambda s, d: rounded(evaluate.std_gap(V.predictions(s, d), ["method", "station_id"]), "std_gap"))
query("location_mean_loss", "predictions", "SELECT method, round(avg(l), 6) AS loss FROM (SELECT method, station_id, avg(pow(out - tgt, 2)) AS l FROM predictions GROUP BY ALL) GROUP BY ALL")(lambda s, d: rounded(evaluate.location_mean_loss(V.predictions(s, d)), "loss"))
query("deviation_weighted_rmse", "predictions", "SELECT method, station_id, round(sqrt(avg(pow(out - tgt, 2) * abs(tgt - m))), 6) AS rmse FROM (SELECT *, avg(tgt) OVER (PARTITION BY method, station_id) AS m FROM predictions) GROUP BY ALL")(lambda s, d: rounded(evaluate.deviation_weighted_rmse(V.predictions(s, d), ["method", "station_id"]), "rmse"))
query("peak_hit_segment", "predictions", "SELECT method, station_id, max(out) >= max(tgt) - 0.2 AS hit FROM predictions GROUP BY ALL")(lambda s, d: evaluate.peak_hit(V.predictions(s, d), ["method", "station_id"]))
query("topk_mse", "predictions", "SELECT method, station_id, round(avg(e), 6) AS mse FROM (SELECT method, station_id, pow(out - tgt, 2) AS e, row_number() OVER (PARTITION BY method, station_id ORDER BY pow(out - tgt, 2) DESC, pos) AS r, count(*) OVER (PARTITION BY method, station_id) AS n FROM predictions) WHERE r <= greatest(1, floor(n * 0.1)) GROUP BY ALL")(lambda s, d: rounded(evaluate.topk_mse(V.predictions(s, d), 0.1, ["method", "station_id"]), "mse"))
query("top_target_mse", "predictions", "SELECT method, station_id, round(avg(e), 6) AS mse FROM (SELECT method, station_id, pow(out - tgt, 2) AS e, row_number() OVER (PARTITION BY method, station_id ORDER BY abs(tgt) DESC, pos) AS r, count(*) OVER (PARTITION BY method, station_id) AS n FROM predictions) WHERE r <= ceil(n * 0.1) GROUP BY ALL")(lambda s, d: rounded(evaluate.top_target_mse(V.predictions(s, d), 0.1, ["method", "station_id"]), "mse"))
query("bin_errors", "predictions bins", "SELECT method, bin, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, count(*) AS n FROM bins WHERE bin IS NOT NULL GROUP BY ALL")(lambda s, d: rounded(evaluate.bin_errors(V.predictions(s, d)), "mean", "std"))
query("bin_errors_given_hit", "predictions bins", "SELECT method, bin, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS std, count(*) AS n FROM bins WHERE bin IS NOT NULL AND (station_id, pos) IN (SELECT (station_id, pos) FROM predictions WHERE method = 'a' AND abs(out - tgt) <= 0.205) GROUP BY ALL")(lambda s, d: rounded(evaluate.bin_errors_given_hit(V.predictions(s, d), "a", 0.205), "mean", "std"))
query("gain_vs_baseline", "predictions bins pairs", "SELECT bin, round(avg(eb - ea), 6) AS gain FROM pairs GROUP BY ALL")(lambda s, d: rounded(evaluate.gain_vs_baseline(V.predictions(s, d), "a", "b"), "gain"))
query("paired_ttest", "predictions bins pairs", "SELECT bin, count(*) AS n, round(avg(ea - eb), 6) AS mean, round(stddev_samp(ea - eb), 6) AS sd, round(avg(ea - eb) * sqrt(count(*)) / stddev_samp(ea - eb), 4) AS t FROM pairs GROUP BY ALL")(lambda s, d: rounded(rounded(evaluate.paired_ttest(V.predictions(s, d), "a", "b"), "mean", "sd"), "t", digits=4))
TESTS = "t AS (SELECT CAST(station_id AS VARCHAR) AS test, round(0.05 * avg(pow(out - tgt, 2)), 6) AS p FROM predictions WHERE method = 'b' GROUP BY ALL)"
TESTED = lambda s, d: V.predictions(s, d).where("method = 'b'").groupBy(F.col("station_id").cast("string").alias("test")).agg(F.round(0.05 * F.avg(F.pow(F.col("out") - F.col("tgt"), 2)), 6).alias("p"))
query("adjust_p_holm", "predictions", f", {TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM t) SELECT test, p, round(least(1.0, max(p * (m - i + 1)) OVER (ORDER BY p, test)), 6) AS p_adj FROM r")(lambda s, d: rounded(evaluate.adjust_p(TESTED(s, d), "holm"), "p_adj"))
query("adjust_p_fdr", "predictions", f", {TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS m FROM t) SELECT test, p, round(least(1.0, min(p * m / i) OVER (ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adj FROM r")(lambda s, d: rounded(evaluate.adjust_p(TESTED(s, d), "fdr_bh"), "p_adj"))
query("station_bin_rmse", "predictions", "SELECT method, station_id, count(*) AS n, round(sqrt(avg(pow(out - tgt, 2))), 6) AS rmse, round(avg(abs(tgt)), 6) AS mean_abs, round(sqrt(avg(pow(out - tgt, 2))) / avg(abs(tgt)), 6) AS relative FROM predictions WHERE abs(tgt) BETWEEN 0.25 AND 0.65 GROUP BY ALL")(lambda s, d: rounded(evaluate.station_bin_rmse(V.predictions(s, d), 0.25, 0.65), "rmse", "mean_abs", "relative"))
query("station_relative_rmse", "predictions", "SELECT method, station_id, round(sqrt(avg(pow((out - tgt) / (abs(tgt) + 0.1), 2))), 6) AS relative FROM predictions GROUP BY ALL")(lambda s, d: rounded(evaluate.station_relative_rmse_per_sample(V.predictions(s, d), 0.1), "relative"))
RMSE = "r AS (SELECT method, station_id, sqrt(avg(pow(out - tgt, 2))) AS rmse FROM predictions GROUP BY ALL)"
RMSES = lambda s, d: V.predictions(s, d).groupBy("method", "station_id").agg(F.sqrt(F.avg(F.pow(F.col("out") - F.col("tgt"), 2))).alias("rmse"))
query("metric_summary", "predictions", f", {RMSE} SELECT method, count(*) AS n, round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS std, round(min(rmse), 6) AS min, round(median(rmse), 6) AS median, round(max(rmse), 6) AS max FROM r GROUP BY ALL")(lambda s, d: rounded(evaluate.metric_summary(RMSES(s, d), "rmse", ["method"]), "mean", "std", "min", "median", "max"))
query("bucket_counts", "predictions", f", {RMSE} SELECT CAST(rmse >= 0.2 AS INT) + CAST(rmse >= 0.25 AS INT) + CAST(rmse >= 0.3 AS INT) AS bucket, count(*) AS n FROM r GROUP BY ALL")(lambda s, d: evaluate.bucket_counts(RMSES(s, d), "rmse", [0.2, 0.25, 0.3]))
query("percent_under", "predictions", f", {RMSE} SELECT t AS threshold, round(100 * avg(CASE WHEN rmse <= t THEN 1.0 ELSE 0 END), 6) AS percent FROM r, (SELECT unnest([0.2, 0.25, 0.29, 0.3])::DOUBLE AS t) GROUP BY ALL")(lambda s, d: rounded(evaluate.percent_under(RMSES(s, d), "rmse", [0.2, 0.25, 0.29, 0.3]), "percent"))
query("outlier_stations", "predictions", "SELECT method, station_id, round(median(abs(out - tgt)), 6) AS median FROM predictions WHERE abs(tgt) BETWEEN 0.05 AND 0.5 GROUP BY ALL HAVING median(abs(out - tgt)) > 0.245")(lambda s, d: rounded(evaluate.outlier_stations(V.predictions(s, d), 0.05, 0.5, 0.245), "median"))
query("degradation_penalty", "predictions", "SELECT a.station_id, round(avg(greatest(0, pow(a.out - a.tgt, 2) - pow(b.out - b.tgt, 2))) + avg(pow(a.out - a.tgt, 2)), 6) AS penalty FROM predictions a JOIN predictions b USING (station_id, pos) WHERE a.method = 'a' AND b.method = 'b' GROUP BY ALL")(lambda s, d: rounded(evaluate.degradation_penalty(V.predictions(s, d), "a", "b"), "penalty"))
query("zstats", "series", """, g AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std FROM series WINDOW w AS (PARTITION BY station_id)), z AS (SELECT *, abs((value - mean) / std) AS z FROM g)
SELECT station_id, round(first(mean), 6) + 0.0 AS mean, round(first(std), 6) AS std, round(max(z), 5) AS z_max, round(avg(z), 5) AS z_mean, round(min(z), 5) AS z_min, round(stddev_pop(z), 5) AS z_std FROM z GROUP BY ALL""")(lambda s, d: rounded(rounded(evaluate.zstats(V.series(s, d), "value", "station_id"), "mean", "std"), "z_max", "z_mean", "z_min", "z_std", digits=5))
query("path_stats", "series", "SELECT station_id, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) + 0.0 AS median FROM series GROUP BY ALL")(lambda s, d: rounded(evaluate.path_stats(V.series(s, d), "value", "station_id"), "mean", "std", "min", "max", "median"))
query("percentile_summary", "series", "SELECT count(*) AS total, count(value) AS valid, count(value) / count(*) AS ratio, " + ", ".join(f"round(quantile_cont(value, {q}), 6) + 0.0 AS p{round(100 * q)}" for q in evaluate.PERCENTS) + " FROM series")(lambda s, d: rounded(evaluate.percentile_summary(V.series(s, d), "value"), *[f"p{round(100 * q)}" for q in evaluate.PERCENTS]))
query("local_maxima", "series", "SELECT station_id, pos, round(value, 6) AS value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY station_id ORDER BY pos)) WHERE value > a AND value > b AND value >= 0.1")(lambda s, d: rounded(evaluate.local_maxima(V.series(s, d), 0.1), "value"))
query("match_peaks", "stations nb series idw", """, p AS (SELECT station_id, pos, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM series WINDOW w AS (PARTITION BY station_id ORDER BY pos)) WHERE value > a AND value > b AND value >= 0.1),
m AS (SELECT p.station_id, p.pos, p.value, round(i.out, 6) AS out, i.pos AS hit_pos, row_number() OVER (PARTITION BY p.station_id, p.pos ORDER BY round(i.out, 6) DESC, i.pos) AS r FROM p JOIN idw i ON i.station_id = p.station_id AND i.pos BETWEEN p.pos - 6 AND p.pos + 6)
SELECT station_id, pos, round(value, 6) AS value, out, round(out - value, 6) AS error, hit_pos - pos AS "offset", out >= value - 0.2 AS hit FROM m WHERE r = 1""")(lambda s, d: rounded(evaluate.match_peaks(evaluate.local_maxima(V.series(s, d), 0.1), interp.weights_apply(interp.idw_weights(neighbors(s, d)), V.series(s, d)).withColumnRenamed("out", "value").withColumn("value", F.round("value", 6))), "value", "out", "error"))

# Rasters

query("downsample", "cells", "SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(z), 6) + 0.0 AS z FROM cells GROUP BY row // 4, col // 4 HAVING count(*) = 16")(lambda s, d: rounded(raster.downsample(V.cells(s, d), 4), "z"))
query("crop", "cells", "SELECT row, col, round(z, 6) + 0.0 AS z FROM cells WHERE row BETWEEN 8 AND 42 AND col BETWEEN 3 AND 32")(lambda s, d: rounded(raster.crop(V.cells(s, d), 10, 5, 40, 30, 2), "z"))
query("slope_degrees", "cells", """, g AS (SELECT row, col, CASE WHEN lag(z) OVER x IS NULL THEN lead(z) OVER x - z WHEN lead(z) OVER x IS NULL THEN z - lag(z) OVER x ELSE (lead(z) OVER x - lag(z) OVER x) / 2 END AS gx,
CASE WHEN lag(z) OVER y IS NULL THEN lead(z) OVER y - z WHEN lead(z) OVER y IS NULL THEN z - lag(z) OVER y ELSE (lead(z) OVER y - lag(z) OVER y) / 2 END AS gy FROM cells WINDOW x AS (PARTITION BY row ORDER BY col), y AS (PARTITION BY col ORDER BY row))
SELECT row, col, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g""")(lambda s, d: rounded(raster.slope_degrees(V.cells(s, d)), "slope"))
query("median_filter", "cells", """, n AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM cells), o AS (SELECT a, b FROM range(-2, 3) t(a), range(-2, 3) u(b)), r AS (SELECT row AS r, col AS c, row + a AS x, col + b AS y, h, w FROM cells, o, n),
f AS (SELECT r, c, CASE WHEN x < 0 THEN -x - 1 WHEN x >= h THEN 2 * h - 1 - x ELSE x END AS row, CASE WHEN y < 0 THEN -y - 1 WHEN y >= w THEN 2 * w - 1 - y ELSE y END AS col FROM r)
SELECT r AS row, c AS col, round(median(z), 6) + 0.0 AS z FROM f JOIN cells USING (row, col) GROUP BY r, c""")(lambda s, d: rounded(raster.median_filter(V.cells(s, d)), "z"))
D8_SQL = ", o AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(raster.D8)) + ") v(i, dr, dc, code)), n AS (SELECT c.row, c.col, c.z, m.z AS mz, i, code FROM cells c, o JOIN cells m ON m.row = c.row + dr AND m.col = c.col + dc), d AS (SELECT row, col, count(*) AS k, min(mz) AS low, first(z) AS z, arg_min(code, (mz, i)) AS code FROM n GROUP BY row, col), dir AS (SELECT row, col, CASE WHEN k = 8 AND low < z THEN code ELSE 0 END AS dir FROM d)"
D8_SQL = D8_SQL.replace("FROM cells c, o JOIN cells m ON m.row = c.row + dr AND m.col = c.col + dc", "FROM cells c CROSS JOIN o JOIN cells m ON m.row = c.row + o.dr AND m.col = c.col + o.dc")
query("d8_direction", "cells", D8_SQL + " SELECT row, col, CAST(dir AS INT) AS dir FROM dir")(lambda s, d: raster.d8_direction(V.cells(s, d)))
query("flow_accumulation", "cells", D8_SQL + """, f AS (SELECT d.row, d.col, d.row + o.dr AS tr, d.col + o.dc AS tc FROM dir d LEFT JOIN o ON o.code = d.dir), up AS (SELECT row AS src_r, col AS src_c, row, col FROM f UNION ALL SELECT src_r, src_c, tr, tc FROM up JOIN f USING (row, col) WHERE tr IS NOT NULL)
SELECT row, col, count(*) AS acc FROM up GROUP BY ALL""")(lambda s, d: raster.flow_accumulation(raster.d8_direction(V.cells(s, d))))
query("flood_fill", "cells", """, ok AS (SELECT row, col FROM cells WHERE z < 0.05), fill AS (SELECT row, col FROM ok WHERE row % 50 = 0 AND col = 10 UNION SELECT ok.row, ok.col FROM fill f JOIN ok ON ((ok.row = f.row AND ok.col IN (f.col - 1, f.col + 1)) OR (ok.col = f.col AND ok.row IN (f.row - 1, f.row + 1))))
SELECT row, col FROM fill""")(lambda s, d: raster.flood_fill(V.cells(s, d).where("row % 50 = 0 and col = 10"), V.cells(s, d).where("z < 0.05").select("row", "col")))
query("corridor", "cells", "SELECT DISTINCT c.row + a AS row, c.col + b AS col FROM cells c, range(-2, 3) t(a), range(-2, 3) u(b) WHERE abs(a) + abs(b) <= 2 AND c.row = c.col")(lambda s, d: raster.corridor(V.cells(s, d).where("row = col"), 2).withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}))
query("threshold_mask", "cells", "SELECT row, col FROM cells WHERE z < 0.5 * (SELECT avg(z) FROM cells)")(lambda s, d: raster.threshold_mask(V.cells(s, d), 0.5))
query("rain_at_stations", "cells", "SELECT CAST(p.row AS BIGINT) AS station_id, round(sum(c.z), 6) + 0.0 AS total FROM cells p JOIN cells c ON c.row BETWEEN p.row - 2 AND p.row + 1 AND c.col BETWEEN p.col - 2 AND p.col + 1 WHERE p.col = 20 GROUP BY p.row")(lambda s, d: rounded(raster.window_sums(V.cells(s, d), V.cells(s, d).where("col = 20").select(F.col("row").cast("long").alias("station_id"), "row", "col"), 2), "total"))

# Graphs

query("hops_to_target", "stations edges", ", h AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS hops UNION SELECT e.src, h.hops + 1 FROM h JOIN edges e ON e.dst = h.node WHERE h.hops < 200), m AS (SELECT node, min(hops) AS hops FROM h GROUP BY ALL), n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT n.node, coalesce(hops, -1) AS hops FROM n LEFT JOIN m USING (node)")(lambda s, d: graph.hops_to_target(edges(s, d), 0))
query("orient_edges", "stations edges", "SELECT src, dst FROM edges WHERE rank <> 2 UNION SELECT dst, src FROM edges WHERE rank <> 1")(lambda s, d: graph.orient_edges(edges(s, d).withColumn("dir", F.when(F.col("rank") == 1, 1).when(F.col("rank") == 2, -1).otherwise(0))))
query("edge_softmax", "stations edges", "SELECT src, dst, round(exp(-km - max(-km) OVER w) / sum(exp(-km)) OVER w * exp(max(-km) OVER w), 6) AS alpha FROM edges WINDOW w AS (PARTITION BY dst)")(lambda s, d: rounded(graph.edge_softmax(edges(s, d).withColumn("score", -F.col("km"))), "alpha"))
query("trim_component", "stations edges", """, e AS (SELECT src, dst FROM edges WHERE rank = 1 AND src % 7 <> 0), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node FROM b WHERE src IN (3, 10) UNION SELECT b.dst FROM r JOIN b ON b.src = r.node) SELECT src, dst FROM e WHERE src IN (SELECT node FROM r)""")(lambda s, d: graph.trim_component(edges(s, d).where("rank = 1 and src % 7 <> 0").select("src", "dst"), s.createDataFrame([(3,), (10,)], "node long")))
query("level_propagate")(lambda s, d: _level(s, d))
LINES = "v AS (SELECT o_custkey AS line_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, 50 + (o_orderkey % 1000) / 1000.0 AS lat, 4 + (o_orderkey % 777) / 777.0 AS lon FROM orders)"
HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"
EDGE_SQL = f"WITH {LINES}, l AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM v WINDOW w AS (PARTITION BY line_id ORDER BY seq)) "
query("lines_to_edges", "", EDGE_SQL + f"SELECT line_id, seq, round({HAVERSINE}, 6) AS km FROM l WHERE lat2 IS NOT NULL")(lambda s, d: rounded(graph.lines_to_edges(_lines(s, d)), "km"))
query("path_length_km", "", EDGE_SQL + f"SELECT line_id, round(sum({HAVERSINE}), 5) AS km FROM l WHERE lat2 IS NOT NULL GROUP BY ALL")(lambda s, d: rounded(graph.path_length_km(_lines(s, d)), "km", digits=5))


def _lines(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("line_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("seq"), (50 + (F.col("o_orderkey") % 1000) / 1000.0).alias("lat"), (4 + (F.col("o_orderkey") % 777) / 777.0).alias("lon"))


def _level(s: SparkSession, d: str) -> DataFrame:
    e = edges(s, d)
    hops = stored(graph.hops_to_target(e, 0), "hops")
    alpha = graph.edge_softmax(e.withColumn("score", -F.col("km")))
    return rounded(graph.level_propagate(V.series(s, d).withColumnRenamed("station_id", "node"), alpha, hops), "value")


query("haversine_km", "stations nb", "SELECT nb.station_id, nb_id, round(" + HAVERSINE + ", 6) AS km FROM (SELECT nb.station_id, nb_id, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM nb JOIN stations a ON a.station_id = nb.station_id JOIN stations b ON b.station_id = nb_id) nb")(lambda s, d: rounded(neighbors(s, d).select("station_id", "nb_id").join(V.stations(s, d).select("station_id", "lat", "lon"), "station_id").join(V.stations(s, d).select(F.col("station_id").alias("nb_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "nb_id").select("station_id", "nb_id", S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")), "km"))
query("stats_report", "series", ", a AS (SELECT round(avg(value), 6) + 0.0 AS mean, round(max(value), 6) AS highest, round(min(value), 6) AS lowest FROM series) UNPIVOT (FROM a) ON mean, highest, lowest INTO NAME metric VALUE value".replace("UNPIVOT (FROM a) ON mean, highest, lowest INTO NAME metric VALUE value", "SELECT 'mean' AS metric, mean AS value FROM a UNION ALL SELECT 'highest', highest FROM a UNION ALL SELECT 'lowest', lowest FROM a"))(lambda s, d: rounded(sensors.stats_report(V.series(s, d).agg(F.avg("value").alias("mean"), F.max("value").alias("highest"), F.min("value").alias("lowest"))), "value"))
query("upsert_missing", "stations nb", "SELECT station_id, nb_id FROM nb WHERE (station_id, nb_id) NOT IN (SELECT (station_id, nb_id) FROM nb WHERE rank <= 2)")(lambda s, d: sensors.upsert_missing(neighbors(s, d).select("station_id", "nb_id"), neighbors(s, d).where("rank <= 2"), ["station_id", "nb_id"]))
query("reverse_edge_features", "stations nb", "SELECT nb.station_id, nb_id, round(a.lat - b.lat, 6) + 0.0 AS dx, round(a.lon - b.lon, 6) + 0.0 AS dy, round(a.elevation - b.elevation, 6) + 0.0 AS dz, -1 AS dir, round(b.width, 6) AS w1, round(a.width, 6) AS w2 FROM nb JOIN stations a ON a.station_id = nb.station_id JOIN stations b ON b.station_id = nb_id")(lambda s, d: rounded(clean.reverse_edge_features(neighbors(s, d).select("station_id", "nb_id").join(V.stations(s, d).select("station_id", "lat", "lon", "elevation", "width"), "station_id").join(V.stations(s, d).select(F.col("station_id").alias("nb_id"), F.col("lat").alias("b1"), F.col("lon").alias("b2"), F.col("elevation").alias("b3"), F.col("width").alias("w2")), "nb_id").select("station_id", "nb_id", (F.col("b1") - F.col("lat")).alias("dx"), (F.col("b2") - F.col("lon")).alias("dy"), (F.col("b3") - F.col("elevation")).alias("dz"), F.lit(1).alias("dir"), F.col("width").alias("w1"), "w2")), "dx", "dy", "dz", "w1", "w2"))
