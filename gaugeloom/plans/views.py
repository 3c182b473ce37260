"""Logical tables over the given ones, for Spark and as SQL text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same tables as common table expressions.
SQL = {
    "stations": "stations AS (SELECT CAST(vec_id AS BIGINT) AS station_id, 50.5 + CAST(embedding[1] AS DOUBLE) AS lat, 4.0 + CAST(embedding[2] AS DOUBLE) AS lon, 100.0 * CAST(embedding[3] AS DOUBLE) AS elevation, 10.0 * (1.0 + abs(CAST(embedding[4] AS DOUBLE))) AS width, label AS cluster FROM embeddings)",
    "series": "series AS (SELECT CAST(vec_id AS BIGINT) AS station_id, CAST(unnest(range(len(embedding))) AS INT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)",
    "readings": "readings AS (SELECT user_id AS station_id, date_trunc('day', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM events GROUP BY ALL)",
    "predictions": """p0 AS (SELECT l_suppkey AS station_id, l_orderkey * 10 + l_linenumber AS pos, 20 * l_tax - 0.8 AS tgt, l_discount, l_quantity FROM lineitem),
predictions AS (SELECT 'a' AS method, station_id, pos, tgt, tgt + (l_discount - 0.05) * 8 AS out FROM p0 UNION ALL SELECT 'b', station_id, pos, tgt, tgt + (l_quantity - 25) / 50 FROM p0)""",
    "cells": "cells AS (SELECT CAST(vec_id AS INT) AS row, CAST(unnest(range(len(embedding))) AS INT) AS col, CAST(unnest(embedding) AS DOUBLE) AS z FROM embeddings)",
}


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = lambda i: F.col("embedding")[i].cast("double")
    return e.select(F.col("vec_id").cast("long").alias("station_id"), (50.5 + x(0)).alias("lat"), (4.0 + x(1)).alias("lon"), (100.0 * x(2)).alias("elevation"), (10.0 * (1.0 + F.abs(x(3)))).alias("width"), F.col("label").alias("cluster"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("long").alias("station_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").cast("int").alias("row"), F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "z"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    return e.groupBy(F.col("user_id").alias("station_id"), day.alias("ts")).agg(F.round(F.avg("value"), 6).alias("value"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    base = li.select(F.col("l_suppkey").alias("station_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (20 * F.col("l_tax") - 0.8).alias("tgt"), "l_discount", "l_quantity")
    out = F.array(F.struct(F.lit("a").alias("method"), (F.col("tgt") + (F.col("l_discount") - 0.05) * 8).alias("out")), F.struct(F.lit("b").alias("method"), (F.col("tgt") + (F.col("l_quantity") - 25) / 50).alias("out")))
    return base.withColumn("m", F.explode(out)).select("m.method", "station_id", "pos", "tgt", "m.out")


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second variable at the places and steps of series: mean price of orders by customer and day of the year, 0 where there are none. Sums are of whole cents, so that their order doesn't count."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = o.groupBy((F.col("o_custkey") % 500).alias("station_id"), (F.dayofyear("o_orderdate") % 64).alias("pos")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / (F.count(F.lit(1)) * 1e7)).alias("r"))
    return series(spark, sf_dir).select("station_id", "pos").join(r, ["station_id", "pos"], "left").select("station_id", "pos", F.coalesce("r", F.lit(0.0)).alias("value"))
