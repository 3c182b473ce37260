"""Vector lines with attributes as vertex tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One feature of a file; coordinates stay text, as their nesting depends on the type, and so does what can't be read.
FEATURE = "type string, properties map<string, string>, geometry struct<type: string, coordinates: string>, _bad string"
POINT = "array<double>"


def read_features(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """file, place, properties, kind, coordinates (text), bad: features of GeoJSON files under path.

    lines: one feature a line; such files are split over tasks. Else each file is one collection, read
    whole by a task. What is no feature has bad set, and place is the order in its file's split.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    if lines:
        rows = reader.schema(FEATURE).json(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.struct("*").alias("f"))
    else:
        whole = reader.option("multiLine", "true").schema(f"features array<struct<{_fields()}>>, _bad string").json(path)
        whole = whole.select(F.col("_metadata.file_path").alias("file"), "features", "_bad")
        none = F.array(F.struct(F.lit(None).cast("string").alias("type"), F.lit(None).cast("map<string,string>").alias("properties"), F.lit(None).cast("struct<type:string,coordinates:string>").alias("geometry")))
        rows = whole.select("file", "_bad", F.posexplode(F.when(F.size("features") > 0, F.col("features")).otherwise(none)).alias("place", "g"))
        rows = rows.select("file", F.col("place").cast("long").alias("place"), F.struct("g.type", "g.properties", "g.geometry", "_bad").alias("f"))
    bad = F.col("f._bad").isNotNull() | F.col("f.geometry.type").isNull()
    return rows.select("file", "place", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), bad.alias("bad"))


def _fields() -> str:
    return "type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>"


def read_line_vertices(spark: SparkSession, path: str, id_key: str | None = None, name_key: str = "name", width_key: str = "width", lines: bool = True) -> DataFrame:
    """line_id, seq, lon, lat, name, width: vertices of all lines of GeoJSON files.

    id_key names the property that numbers a feature; without one, ids are hashes of the file and the
    place in it. Parts of a multi-line after the first are lines of their own, with ids hashed from the
    feature's and the part. Features of other kinds, and what can't be read, give no rows
    (`line_file_report` counts them); a vertex without two numbers leaves its line with a gap in seq.
    """
    f = read_features(spark, path, lines).where(~F.col("bad") & F.col("kind").isin("LineString", "MultiLineString"))
    own = F.expr(f"try_cast(properties['{id_key}'] AS bigint)") if id_key else F.xxhash64("file", "place")
    parts = F.when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", f"array<{POINT}>"))).otherwise(F.from_json("coordinates", f"array<array<{POINT}>>"))
    f = f.select(own.alias("id"), F.col("properties")[name_key].alias("name"), F.regexp_replace(F.col("properties")[width_key], ",", ".").try_cast("double").alias("width"), F.posexplode(parts).alias("part", "points"))
    line = F.when(F.col("part") == 0, F.col("id")).otherwise(F.xxhash64("id", "part"))
    v = f.select(line.alias("line_id"), "name", "width", F.posexplode("points").alias("seq", "p"))
    return v.select("line_id", "seq", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"), "name", "width").where("lon is not null and lat is not null")


def line_file_report(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """file, features, lines, others (points, areas), bad: what each file holds."""
    f = read_features(spark, path, lines)
    is_line = F.col("kind").isin("LineString", "MultiLineString")
    count = lambda c: F.sum(c.cast("long"))
    return f.groupBy("file").agg(F.count(F.lit(1)).alias("features"), count(~F.col("bad") & is_line).alias("lines"), count(~F.col("bad") & ~is_line).alias("others"), count(F.col("bad")).alias("bad"))
