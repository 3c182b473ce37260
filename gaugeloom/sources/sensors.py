"""Sensor files, rasters, tiles and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import decimal_comma


def parse_sensor_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines "time;number" to (ts_text, ts, value), beside the frame's other columns: "#" lines and lines of one field go, an empty number is null."""
    parts = F.split(F.col(col), ";")
    good = lines.where(~F.col(col).startswith("#")).where(F.size(parts) >= 2)
    others = [c for c in lines.columns if c != col]
    return good.select(*others, F.trim(parts[0]).alias("ts_text"), F.try_to_timestamp(F.trim(parts[0])).alias("ts"), decimal_comma(parts[1]).alias("value"))


def discover(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """file, stem, bytes, modified: all files under path, at any depth, but for empty ones. Only names and sizes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", f"*.{extension}") if extension else reader).load(path)
    return files.select(F.col("path").alias("file"), F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("stem"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def sensor_lines(spark: SparkSession, path: str, extension: str = "csv") -> DataFrame:
    """Raw lines of all sensor files under path: sensor (the file's stem), file, value. Files may lie in any store that Spark reads."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return lines.select(stem.alias("sensor"), F.col("_metadata.file_path").alias("file"), "value")


def read_sensor_csv(spark: SparkSession, path: str, extension: str = "csv") -> DataFrame:
    """sensor, ts, value of all sensor files under path (`parse_sensor_lines`)."""
    return parse_sensor_lines(sensor_lines(spark, path, extension)).select("sensor", "ts", "value")


def sensor_file_report(spark: SparkSession, path: str, extension: str = "csv") -> DataFrame:
    """A row for each file with lines: sensor, lines, headers, short (one field), empty (no number), bad_time, bad_number."""
    parts = F.split("value", ";")
    lines = sensor_lines(spark, path, extension).withColumn("header", F.col("value").startswith("#"))
    lines = lines.withColumn("short", ~F.col("header") & (F.size(parts) < 2)).withColumn("data", ~F.col("header") & ~F.col("short"))
    number = F.trim(F.get(parts, 1))
    count = lambda c: F.sum(c.cast("long"))
    return lines.groupBy("file", "sensor").agg(
        F.count(F.lit(1)).alias("lines"), count(F.col("header")).alias("headers"), count(F.col("short")).alias("short"), count(F.col("data") & (number == "")).alias("empty"),
        count(F.col("data") & F.try_to_timestamp(F.trim(parts[0])).isNull()).alias("bad_time"), count(F.col("data") & (number != "") & decimal_comma(number).isNull()).alias("bad_number"),
    ).drop("file")


def attach_station(readings: DataFrame, meta: DataFrame, on: str = "sensor") -> DataFrame:
    return readings.join(meta, on)


def raster_time(df: DataFrame, col: str = "file") -> DataFrame:
    """ts from a file name that holds YYYY-MM-DD-HH."""
    part = lambda i: F.regexp_extract(F.col(col), r"(\d{4})-(\d{2})-(\d{2})-(\d{2})", i).try_cast("int")
    return df.withColumn("ts", F.try_make_timestamp(part(1), part(2), part(3), part(4), F.lit(0), F.lit(0)))


def read_raster_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cell table; unreadable files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path)


def tile_bounds(cells: DataFrame) -> DataFrame:
    return cells.groupBy("tile").agg(F.min("lon").alias("minlon"), F.min("lat").alias("minlat"), F.max("lon").alias("maxlon"), F.max("lat").alias("maxlat"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_predictions(df: DataFrame, path: str) -> None:
    write_table(df, path, ["method"])


def upsert_missing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys have no output yet."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def stats_report(df: DataFrame) -> DataFrame:
    """One-row statistics as (metric, value)."""
    return df.unpivot([], df.columns, "metric", "value")
