"""Masks, centring, quality rules of segments, features of edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def whole():
    return Window.partitionBy("station_id")


def by_pos():
    return Window.partitionBy("station_id").orderBy("pos")


def order_latlon(df: DataFrame, a: str, b: str, lat_range: tuple[float, float], lon_range: tuple[float, float]) -> DataFrame:
    """Decide which of two numbers is the latitude by ranges; in doubt the first."""
    swapped = F.col(a).between(*lon_range) & F.col(b).between(*lat_range) & ~(F.col(a).between(*lat_range) & F.col(b).between(*lon_range))
    return df.withColumns({"lat": F.when(swapped, F.col(b)).otherwise(F.col(a)), "lon": F.when(swapped, F.col(a)).otherwise(F.col(b))})


def bbox_filter(df: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    return df.where(F.col("lon").between(bounds[0], bounds[2]) & F.col("lat").between(bounds[1], bounds[3]))


def bounds_of(nodes: DataFrame, buffer: float = 0.0) -> DataFrame:
    return nodes.agg((F.min("lon") - buffer).alias("minlon"), (F.min("lat") - buffer).alias("minlat"), (F.max("lon") + buffer).alias("maxlon"), (F.max("lat") + buffer).alias("maxlat"))


def valid_mask(series: DataFrame) -> DataFrame:
    return series.withColumn("valid", F.col("value") > 0)


def center_by_median(series: DataFrame) -> DataFrame:
    med = series.groupBy("station_id").agg(F.median("value").alias("med"))
    return series.join(med, "station_id").withColumn("value", F.col("value") - F.col("med")).drop("med")


def abs_deviation_range(series: DataFrame) -> DataFrame:
    med = series.groupBy("station_id").agg(F.median("value").alias("med"))
    d = F.abs(F.col("value") - F.col("med"))
    return series.join(med, "station_id").groupBy("station_id").agg((F.max(d) - F.min(d)).alias("range"))


def segment_quality(series: DataFrame, max_dev: float = 4.0, max_jump: float = 0.5) -> DataFrame:
    """Stations whose mean deviation from the median and whose largest upward step of the deviation are small."""
    med = series.groupBy("station_id").agg(F.median("value").alias("med"))
    d = series.join(med, "station_id").withColumn("d", F.abs(F.col("value") - F.col("med")))
    d = d.withColumn("jump", F.col("d") - F.lag("d").over(by_pos()))
    return d.groupBy("station_id").agg(F.avg("d").alias("mean_dev"), F.max("jump").alias("max_jump")).where((F.col("mean_dev") < max_dev) & (F.col("max_jump") < max_jump))


def amplitude_filter(series: DataFrame, low: float, high: float) -> DataFrame:
    return series.groupBy("station_id").agg((F.max("value") - F.min("value")).alias("amplitude")).where((F.col("amplitude") > low) & (F.col("amplitude") < high))


def significant_change(series: DataFrame, z: float = 4.0, least: float = 0.2) -> DataFrame:
    """Replace outliers by a median filter of 7, zero padded; tell which series still change by more than least."""
    around = [F.coalesce(F.lag("value", k).over(by_pos()), F.lit(0.0)) for k in range(3, -4, -1)]
    f = series.withColumn("f", F.sort_array(F.array(*around))[3]).withColumn("r", F.col("value") - F.col("f"))
    f = f.withColumn("sd", F.stddev_pop("r").over(whole()))
    v = F.when(F.abs(F.col("r") / (F.col("sd") + 1e-8)) > z, F.col("f")).otherwise(F.col("value"))
    return f.withColumn("v", v).groupBy("station_id").agg((F.max("v") - F.min("v")).alias("span")).withColumn("significant", F.col("span") > least)


def _scored(series: DataFrame) -> DataFrame:
    med = series.groupBy("station_id").agg(F.median("value").alias("med"))
    d = series.join(med, "station_id").withColumn("d", F.abs(F.col("value") - F.col("med")))
    mad = d.groupBy("station_id").agg(F.median("d").alias("mad"))
    return d.join(mad, "station_id").withColumn("z", F.col("d") / (F.col("mad") + 1e-8))


def spike_runs(series: DataFrame, z: float = 6.0) -> DataFrame:
    """Maximal runs of points beyond z median absolute deviations: station_id, start, end (exclusive), length."""
    s = _scored(series).where(F.col("z") > z)
    island = F.col("pos") - F.row_number().over(by_pos())
    runs = s.withColumn("island", island).groupBy("station_id", "island").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("length"))
    return runs.drop("island")


def suppress_spikes(series: DataFrame, z: float = 6.0, max_len: int = 8, context: int = 5) -> DataFrame:
    """Short runs of outliers replaced by the median of the points around them, left to right (one series is one group)."""

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["value"].to_numpy(float).copy()
        d = np.abs(x - np.median(x))
        out = np.flatnonzero(d / (np.median(d) + 1e-8) > z)
        for run in np.split(out, np.flatnonzero(np.diff(out) > 1) + 1) if len(out) else []:
            if len(run) <= max_len:
                near = np.concatenate([x[max(0, run[0] - context) : run[0]], x[run[-1] + 1 : run[-1] + 1 + context]])
                if len(near):
                    x[run] = np.median(near)
        return pdf.assign(value=x)

    return series.groupBy("station_id").applyInPandas(fix, series.schema)


def eligible_stations(segments: DataFrame, neighbors: DataFrame, min_weeks: int = 10) -> DataFrame:
    """Stations with enough weeks and at least one neighbour, all of whose neighbours have enough weeks."""
    rich = segments.groupBy("station_id").count().where(F.col("count") >= min_weeks).select("station_id")
    poor = neighbors.join(rich.withColumnRenamed("station_id", "nb_id"), "nb_id", "left_anti").select("station_id")
    return rich.join(neighbors.select("station_id"), "station_id", "left_semi").join(poor, "station_id", "left_anti")


def reverse_edge_features(df: DataFrame) -> DataFrame:
    """The edge seen from its other end: displacement, height difference and direction negated, widths swapped."""
    return df.withColumns({"dx": -F.col("dx"), "dy": -F.col("dy"), "dz": -F.col("dz"), "dir": -F.col("dir"), "w1": F.col("w2"), "w2": F.col("w1")})


def time_slice(readings: DataFrame, start: str, days: int) -> DataFrame:
    a = F.lit(start).cast("timestamp")
    return readings.where((F.col("ts") >= a) & (F.col("ts") < a + F.make_dt_interval(F.lit(days))))
