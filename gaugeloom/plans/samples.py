"""Registered queries of training rows: a week is sixteen steps of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import training
from . import queries as Q
from . import views as V
from .queries import query, rounded
from .variables import RAIN

SEGMENTS = """sg AS (SELECT station_id, pos // 16 AS week, CAST(pos % 16 AS INT) AS pos, value FROM series), sm AS (SELECT station_id, median(value) AS med FROM sg GROUP BY ALL),
wq AS (SELECT station_id, week, avg(d) AS mean_dev, max(jump) AS max_jump FROM (SELECT *, d - lag(d) OVER (PARTITION BY station_id, week ORDER BY pos) AS jump FROM (SELECT sg.*, abs(value - med) AS d FROM sg JOIN sm USING (station_id))) GROUP BY ALL),
gs AS (SELECT sg.* FROM sg JOIN wq USING (station_id, week) WHERE mean_dev < 4 AND max_jump < 0.3)"""


def _weekly(series: DataFrame) -> DataFrame:
    return series.select("station_id", F.floor(F.col("pos") / 16).cast("int").alias("week"), (F.col("pos") % 16).cast("int").alias("pos"), "value")


def _good(s: SparkSession, d: str) -> DataFrame:
    sg = _weekly(V.series(s, d))
    return Q.stored(sg.join(training.week_quality(sg, 4.0, 0.3).where("kept"), training.WEEK, "left_semi"), "good-weeks")


query("week_quality", "series", f", {SEGMENTS} SELECT station_id, CAST(week AS INT) AS week, round(mean_dev, 6) AS mean_dev, round(max_jump, 6) AS max_jump, mean_dev < 4 AND max_jump < 0.3 AS kept FROM wq")(
    lambda s, d: rounded(training.week_quality(_weekly(V.series(s, d)), 4.0, 0.3), "mean_dev", "max_jump")
)
query("significant_weeks", "series", f""", {SEGMENTS}, f AS (SELECT *, list_sort([{", ".join(f"coalesce({f} OVER w, 0)" for f in ("lag(value, 3)", "lag(value, 2)", "lag(value, 1)", "lag(value, 0)", "lead(value, 1)", "lead(value, 2)", "lead(value, 3)"))}])[4] AS f FROM sg WINDOW w AS (PARTITION BY station_id, week ORDER BY pos)),
r AS (SELECT *, abs((value - f) / (stddev_pop(value - f) OVER (PARTITION BY station_id, week) + 1e-8)) > 2 AS replaced FROM f), v AS (SELECT *, CASE WHEN replaced THEN f ELSE value END AS v FROM r)
SELECT station_id, CAST(week AS INT) AS week, pos, round(v, 6) + 0.0 AS value, replaced, max(v) OVER (PARTITION BY station_id, week) - min(v) OVER (PARTITION BY station_id, week) > 0.4 AS significant FROM v""")(
    lambda s, d: rounded(training.significant_weeks(_weekly(V.series(s, d)), z=2.0, least=0.4), "value")
)

# Features of pairs: an edge's profile is that of its two stations

STATS = """es AS (SELECT src, dst, km AS distance, b.lat - a.lat AS dx, b.lon - a.lon AS dy, (a.elevation + b.elevation) / 2 AS mean, abs(a.elevation - b.elevation) / 2 AS std, least(a.elevation, b.elevation) AS min, greatest(a.elevation, b.elevation) AS max, (a.elevation + b.elevation) / 2 AS median, b.elevation AS key_elevation, a.elevation AS src_elevation
FROM edges JOIN stations a ON a.station_id = src JOIN stations b ON b.station_id = dst WHERE (src + dst) % 3 <> 0)"""


def _stats(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    at = lambda i, p: V.stations(s, d).select(c("station_id").alias(i), c("lat").alias(f"{p}lat"), c("lon").alias(f"{p}lon"), c("elevation").alias(f"{p}z"))
    e = Q.edges(s, d).where("(src + dst) % 3 <> 0").join(at("src", "a"), "src").join(at("dst", "b"), "dst")
    mean = (c("az") + c("bz")) / 2
    return e.select("src", "dst", c("km").alias("distance"), (c("blat") - c("alat")).alias("dx"), (c("blon") - c("alon")).alias("dy"), mean.alias("mean"), (F.abs(c("az") - c("bz")) / 2).alias("std"), F.least("az", "bz").alias("min"), F.greatest("az", "bz").alias("max"), mean.alias("median"), c("bz").alias("key_elevation"), c("az").alias("src_elevation"))


NUMBERS = ("distance", "dx", "dy", *training.STATISTICS, "dz", "nb_width", "width", "lat", "lon", "nb_lat", "nb_lon")
VECTOR = ", ".join(f"round(CASE WHEN f.src IS NOT NULL THEN f.{x} WHEN r.src IS NOT NULL THEN r.{x} ELSE {y} END, 6) + 0.0 AS {x}" for x, y in {"distance": "-1", "dx": "b.lat - a.lat", "dy": "b.lon - a.lon", **{x: "-1" for x in training.STATISTICS}}.items())
query("edge_vectors", "stations nb edges", f""", {STATS} SELECT nb.station_id, nb.nb_id, {VECTOR}, round(CASE WHEN f.src IS NOT NULL THEN f.key_elevation - f.src_elevation WHEN r.src IS NOT NULL THEN r.key_elevation - r.src_elevation ELSE b.elevation - a.elevation END, 6) + 0.0 AS dz,
CASE WHEN f.src IS NOT NULL THEN -1 WHEN r.src IS NOT NULL THEN 1 ELSE 0 END AS dir, round(b.width, 6) AS nb_width, round(a.width, 6) AS width, round(a.lat, 6) AS lat, round(a.lon, 6) AS lon, round(b.lat, 6) AS nb_lat, round(b.lon, 6) AS nb_lon
FROM nb JOIN stations a ON a.station_id = nb.station_id JOIN stations b ON b.station_id = nb_id LEFT JOIN es f ON f.src = nb.station_id AND f.dst = nb_id LEFT JOIN es r ON r.dst = nb.station_id AND r.src = nb_id""")(
    lambda s, d: rounded(training.edge_vectors(Q.neighbors(s, d), _stats(s, d), V.stations(s, d)), *NUMBERS)
)
PAIRS = f"""{SEGMENTS}, en AS (SELECT station_id FROM (SELECT DISTINCT station_id, week FROM gs) GROUP BY station_id HAVING count(*) >= 2), pa AS (SELECT station_id, nb_id, rank FROM nb WHERE rank <= 2 AND station_id IN (SELECT station_id FROM en) AND nb_id IN (SELECT station_id FROM en) AND station_id NOT IN (3, 4, 5)),
gw AS (SELECT DISTINCT station_id, week FROM gs), sh AS (SELECT p.station_id, w.week FROM pa p JOIN gw w ON w.station_id = p.nb_id GROUP BY p.station_id, w.week HAVING count(*) = (SELECT count(*) FROM pa q WHERE q.station_id = p.station_id) AND (p.station_id, w.week) IN (SELECT (station_id, week) FROM gw))"""


def _pairs(s: SparkSession, d: str, segments: DataFrame) -> DataFrame:
    return Q.stored(training.usable_neighbors(segments, Q.neighbors(s, d).where("rank <= 2"), 2, [3, 4, 5]), "usable")


query("shared_weeks", "stations nb series", f", {PAIRS} SELECT station_id, CAST(week AS INT) AS week FROM sh")(lambda s, d: training.shared_weeks(g := _good(s, d), _pairs(s, d, g)))
query("one_week", "stations nb series", f", {PAIRS} SELECT station_id, CAST(arg_min(week, md5('7:' || station_id || ':' || week)) AS INT) AS week FROM sh GROUP BY ALL")(lambda s, d: training.one_week(training.shared_weeks(g := _good(s, d), _pairs(s, d, g)), 7))


@query("training_samples", "stations nb series", f""", {PAIRS}, {RAIN}, gm AS (SELECT station_id, median(value) AS med FROM gs GROUP BY ALL)
SELECT p.station_id, CAST(o.week AS INT) AS week, o.pos, nb_id, rank, round(v.value - n.med, 6) + 0.0 AS x, v.value > 0 AS valid, round(n.med, 6) + 0.0 AS es, round(o.value - m.med, 6) + 0.0 AS y, r.value AS rain, q.value AS nb_rain
FROM pa p JOIN gs o ON o.station_id = p.station_id JOIN sh ON sh.station_id = o.station_id AND sh.week = o.week JOIN gs v ON v.station_id = nb_id AND v.week = o.week AND v.pos = o.pos JOIN gm m ON m.station_id = p.station_id JOIN gm n ON n.station_id = nb_id
LEFT JOIN rain r ON r.station_id = p.station_id AND r.pos = o.week * 16 + o.pos LEFT JOIN rain q ON q.station_id = nb_id AND q.pos = o.week * 16 + o.pos""")
def _samples(s: SparkSession, d: str) -> DataFrame:
    g = _good(s, d)
    p = _pairs(s, d, g)
    return rounded(training.training_samples(g, p, training.shared_weeks(g, p), _weekly(V.rain(s, d))), "x", "es", "y")


# Profiles: a path of cells for every station with a third of them missing; the cells' slope is a column's difference

PROFILE = ", ".join(f"{f}({v}) AS {p}{n}" for v, p in (("z", "z_"), ("sl", "slope_")) for n, f in zip(training.STATISTICS, ("avg", "stddev_pop", "min", "max", "median")))
PROFILES = [f"{p}{n}" for p in ("z_", "slope_") for n in training.STATISTICS] + ["distance", "d_lat", "d_lon", "delta_z", "end_slope", "start_z", "end_z"]


@query("path_profile", "stations cells", f""", pt AS (SELECT row AS id, col AS seq, row, col, z FROM cells WHERE row % 3 <> 0 AND col <= 10 + row % 5), sl AS (SELECT row, col, z * z AS sl FROM cells),
gr AS (SELECT pt.id, {PROFILE}, arg_min(z, seq) AS start_z, arg_max(z, seq) AS end_z, arg_max(sl, seq) AS end_slope FROM pt JOIN sl ON sl.row = pt.row AND sl.col = pt.col GROUP BY ALL),
no AS (SELECT station_id AS id, 0 AS seq, lat, lon FROM stations WHERE station_id % 3 <> 0 UNION ALL SELECT station_id, 1, lat + 0.01::DOUBLE, lon FROM stations WHERE station_id % 3 <> 0 UNION ALL SELECT station_id, 2, lat + 0.01::DOUBLE, lon - 0.02::DOUBLE FROM stations WHERE station_id % 3 <> 0),
le AS (SELECT a.id, sum(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))) AS distance FROM no a JOIN no b ON b.id = a.id AND b.seq = a.seq + 1 GROUP BY ALL),
pl AS (SELECT id, arg_max(lat, seq) - arg_min(lat, seq) AS d_lat, arg_max(lon, seq) - arg_min(lon, seq) AS d_lon FROM no GROUP BY ALL), al AS (SELECT *, end_z - start_z AS delta_z FROM gr)
SELECT s.station_id AS id, {", ".join(f"round(coalesce({n}, -1), 6) + 0.0 AS {n}" for n in PROFILES)} FROM stations s LEFT JOIN al ON al.id = station_id LEFT JOIN le ON le.id = station_id LEFT JOIN pl ON pl.id = station_id""")
def _profile(s: SparkSession, d: str) -> DataFrame:
    c, st = F.col, V.stations(s, d)
    z = V.cells(s, d)
    paths = z.where((c("row") % 3 != 0) & (c("col") <= 10 + c("row") % 5)).select(c("row").cast("long").alias("id"), c("col").alias("seq"), "row", "col")
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), (c("lat") + a).alias("lat"), (c("lon") - b).alias("lon")) for i, (a, b) in enumerate(((0.0, 0.0), (0.01, 0.0), (0.01, 0.02)))]))
    nodes = st.where("station_id % 3 <> 0").select(c("station_id").alias("id"), spots.alias("n")).select("id", "n.*")
    return rounded(training.path_profile(paths, z, z.withColumn("slope", c("z") * c("z")), nodes, st.select(c("station_id").alias("id"))), *PROFILES)
