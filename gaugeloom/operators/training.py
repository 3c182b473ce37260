"""Rows that models read: weeks that pass the checks, cleaned series, features of neighbours, and samples.

segments: station_id, week, pos, value; a week is a segment of its own, and its steps meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import haversine_km

WEEK = ["station_id", "week"]
#: Statistics of a profile, in the order that models take them.
STATISTICS = ("mean", "std", "min", "max", "median")


def _steps() -> Window:
    return Window.partitionBy(*WEEK).orderBy("pos")


def station_medians(segments: DataFrame) -> DataFrame:
    return segments.groupBy("station_id").agg(F.median("value").alias("med"))


def week_quality(segments: DataFrame, max_dev: float = 4.0, max_jump: float = 0.5) -> DataFrame:
    """station_id, week, mean_dev, max_jump, kept: deviations from the station's median over all its weeks.

    A week is kept if its mean deviation and its largest rise of the deviation from one step to the next are small. A week of one
    step has no rise, and isn't kept, nor is one without values.
    """
    d = segments.join(station_medians(segments), "station_id").withColumn("d", F.abs(F.col("value") - F.col("med")))
    d = d.withColumn("jump", F.col("d") - F.lag("d").over(_steps()))
    q = d.groupBy(*WEEK).agg(F.avg("d").alias("mean_dev"), F.max("jump").alias("max_jump"))
    return q.withColumn("kept", F.coalesce((F.col("mean_dev") < max_dev) & (F.col("max_jump") < max_jump), F.lit(False)))


def significant_weeks(segments: DataFrame, width: int = 7, z: float = 4.0, least: float = 0.2) -> DataFrame:
    """station_id, week, pos, value, replaced, significant: each week's cleaned series, and whether it still changes by more than least.

    Values whose residual from a median filter, zero padded, exceeds z of the week's deviations are replaced by the filter's.
    """
    half = width // 2
    around = [F.coalesce(F.lag("value", k).over(_steps()), F.lit(0.0)) for k in range(half, -half - 1, -1)]
    whole = Window.partitionBy(*WEEK)
    f = segments.withColumn("f", F.sort_array(F.array(*around))[half]).withColumn("r", F.col("value") - F.col("f"))
    f = f.withColumn("replaced", F.abs(F.col("r") / (F.stddev_pop("r").over(whole) + 1e-8)) > z)
    f = f.withColumn("value", F.when(F.col("replaced"), F.col("f")).otherwise(F.col("value")))
    return f.select(*WEEK, "pos", "value", "replaced", (F.max("value").over(whole) - F.min("value").over(whole) > least).alias("significant"))


def path_profile(paths: DataFrame, cells: DataFrame, slope: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """id; z and slope statistics; distance (km), d_lat, d_lon, delta_z, end_slope, start_z, end_z: -1 where nothing is known.

    paths: id, seq, row, col; nodes: id, seq, lat, lon, the places that the path goes through; wanted: the ids asked for.
    """
    c = F.col
    along = paths.join(cells.select("row", "col", "z"), ["row", "col"], "left").join(slope.select("row", "col", "slope"), ["row", "col"], "left")
    stats = lambda v, p: [F.avg(v).alias(f"{p}mean"), F.stddev_pop(v).alias(f"{p}std"), F.min(v).alias(f"{p}min"), F.max(v).alias(f"{p}max"), F.median(v).alias(f"{p}median")]
    ends = [F.min_by("z", "seq").alias("start_z"), F.max_by("z", "seq").alias("end_z"), F.max_by("slope", "seq").alias("end_slope")]
    ground = along.groupBy("id").agg(*stats("z", "z_"), *stats("slope", "slope_"), *ends)
    after = nodes.select("id", (c("seq") - 1).alias("seq"), c("lat").alias("lat2"), c("lon").alias("lon2"))
    length = nodes.join(after, ["id", "seq"]).groupBy("id").agg(F.sum(haversine_km(c("lat"), c("lon"), c("lat2"), c("lon2"))).alias("distance"))
    place = nodes.groupBy("id").agg((F.max_by("lat", "seq") - F.min_by("lat", "seq")).alias("d_lat"), (F.max_by("lon", "seq") - F.min_by("lon", "seq")).alias("d_lon"))
    out = wanted.select("id").distinct().join(ground, "id", "left").join(place, "id", "left").join(length, "id", "left").withColumn("delta_z", c("end_z") - c("start_z"))
    names = [f"{p}{s}" for p in ("z_", "slope_") for s in STATISTICS] + ["distance", "d_lat", "d_lon", "delta_z", "end_slope", "start_z", "end_z"]
    return out.select("id", *[F.coalesce(n, F.lit(-1.0)).alias(n) for n in names])


def edge_vectors(pairs: DataFrame, stats: DataFrame, stations: DataFrame) -> DataFrame:
    """station_id, nb_id and the features of a pair: distance, dx, dy, statistics of elevation, dz, dir, widths and coordinates.

    stats: src, dst, distance, dx, dy, mean, std, min, max, median, key_elevation, src_elevation. The row from the
    station to its neighbour counts (dir -1), else that of the other direction, as it stands (dir 1); without either, distance
    and statistics are -1, displacement and dz follow from the two stations, and dir is 0.
    """
    c = F.col
    known = ("distance", "dx", "dy", *STATISTICS)

    def row(side: str) -> DataFrame:
        a, b = ("src", "dst") if side == "f" else ("dst", "src")
        values = F.struct(*known, (c("key_elevation") - c("src_elevation")).alias("dz"))
        return stats.select(c(a).alias("station_id"), c(b).alias("nb_id"), values.alias(side))

    at = lambda i, p: stations.select(c("station_id").alias(i), *[c(x).alias(f"{p}{x}") for x in ("lat", "lon", "elevation", "width")])
    j = pairs.select("station_id", "nb_id").distinct().join(row("f"), ["station_id", "nb_id"], "left").join(row("r"), ["station_id", "nb_id"], "left")
    j = j.join(at("station_id", ""), "station_id").join(at("nb_id", "nb_"), "nb_id")
    absent = {"dx": c("nb_lat") - c("lat"), "dy": c("nb_lon") - c("lon"), "dz": c("nb_elevation") - c("elevation")}
    told = [F.when(c("f").isNotNull(), c(f"f.{x}")).when(c("r").isNotNull(), c(f"r.{x}")).otherwise(absent.get(x, F.lit(-1.0))).alias(x) for x in (*known, "dz")]
    way = F.when(c("f").isNotNull(), -1).when(c("r").isNotNull(), 1).otherwise(0).alias("dir")
    return j.select("station_id", "nb_id", *told, way, "nb_width", "width", "lat", "lon", "nb_lat", "nb_lon")


def usable_neighbors(segments: DataFrame, neighbors: DataFrame, least_weeks: int = 10, deny: list[int] | None = None) -> DataFrame:
    """Pairs (station_id, nb_id, rank) of stations with enough weeks; denied stations are no targets, but may be neighbours."""
    enough = segments.select(*WEEK).distinct().groupBy("station_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_weeks).select("station_id")
    pairs = neighbors.select("station_id", "nb_id", "rank").where("station_id <> nb_id").join(enough, "station_id", "left_semi").join(enough.withColumnRenamed("station_id", "nb_id"), "nb_id", "left_semi")
    return pairs.where(~F.col("station_id").isin(deny)) if deny else pairs


def shared_weeks(segments: DataFrame, pairs: DataFrame) -> DataFrame:
    """station_id, week: the weeks that a target and all its neighbours have."""
    weeks = segments.select(*WEEK).distinct()
    need = pairs.groupBy("station_id").agg(F.countDistinct("nb_id").alias("n"))
    have = pairs.select("station_id", "nb_id").distinct().join(weeks.withColumnRenamed("station_id", "nb_id"), "nb_id").groupBy(*WEEK).agg(F.count(F.lit(1)).alias("m"))
    return have.join(need, "station_id").where("m = n").join(weeks, WEEK, "left_semi").select(*WEEK)


def one_week(weeks: DataFrame, seed: int) -> DataFrame:
    """One of each station's weeks, drawn by a hash, for training; all of them serve for tests."""
    draw: Column = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), "station_id", "week"))
    return weeks.groupBy("station_id").agg(F.min_by("week", draw).alias("week"))


def training_samples(segments: DataFrame, pairs: DataFrame, weeks: DataFrame, rain: DataFrame | None = None) -> DataFrame:
    """station_id, week, pos, nb_id, rank, x, valid, es, y and, with rain, rain and nb_rain: targets beside their neighbours.

    Values are less their station's median (es: the neighbour's); valid: the neighbour's value itself is above 0. A step that the
    target or the neighbour lacks has no row. rain: station_id, week, pos, value.
    """
    c = F.col
    med = station_medians(segments)
    own = segments.join(weeks, WEEK, "left_semi").join(med, "station_id").select(*WEEK, "pos", (c("value") - c("med")).alias("y"))
    near = segments.join(med, "station_id").select(c("station_id").alias("nb_id"), "week", "pos", c("value").alias("v"), c("med").alias("es"))
    out = pairs.select("station_id", "nb_id", "rank").join(own, "station_id").join(near, ["nb_id", "week", "pos"])
    out = out.select(*WEEK, "pos", "nb_id", "rank", (c("v") - c("es")).alias("x"), (c("v") > 0).alias("valid"), "es", "y")
    if rain is not None:
        out = out.join(rain.select(*WEEK, "pos", c("value").alias("rain")), [*WEEK, "pos"], "left")
        out = out.join(rain.select(c("station_id").alias("nb_id"), "week", "pos", c("value").alias("nb_rain")), ["nb_id", "week", "pos"], "left")
    return out
