"""Registered queries of the readers: tables are written as files to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.supersteps import shared_folder
from ..sources import sensors, vectors
from .network import VERTICES, line_vertices
from .queries import query, rounded

LINES_SQL = """l AS (SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN '# ' || event_id WHEN event_id % 13 = 0 THEN 'short' WHEN event_id % 7 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ';' WHEN event_id % 17 = 0 THEN 'never;1,5'
ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ';' || (event_id % 1000) || ',' || (10 + event_id % 90) END AS line FROM events)"""


def _sensor_files(s: SparkSession, d: str) -> str:
    i, time = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    number = F.concat((i % 1000).cast("string"), F.lit(","), (10 + i % 90).cast("string"))
    line = (
        F.when(i % 11 == 0, F.concat(F.lit("# "), i.cast("string"))).when(i % 13 == 0, "short").when(i % 7 == 0, F.concat(time, F.lit(";")))
        .when(i % 17 == 0, "never;1,5").otherwise(F.concat(time, F.lit(";"), number))
    )
    path = f"{shared_folder(s)}/files/sensors-{uuid.uuid4().hex}"
    s.read.parquet(f"{d}/events.parquet").select(line.alias("value")).write.text(path)
    return path


query("read_sensor_csv", "", f"""WITH {LINES_SQL} SELECT strftime(TRY_CAST(split_part(line, ';', 1) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS time, TRY_CAST(nullif(replace(split_part(line, ';', 2), ',', '.'), '') AS DOUBLE) AS value FROM l WHERE NOT starts_with(line, '#') AND contains(line, ';')""")(
    lambda s, d: sensors.read_sensor_csv(s, _sensor_files(s, d), "txt").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "value")
)


@query("sensor_file_report", "", f"""WITH {LINES_SQL} SELECT count(*) AS lines, count(*) FILTER (starts_with(line, '#')) AS headers, count(*) FILTER (line = 'short') AS short, count(*) FILTER (ends_with(line, ';')) AS empty, count(*) FILTER (starts_with(line, 'never')) AS bad_time, 0::BIGINT AS bad_number FROM l""")
def _report(s: SparkSession, d: str) -> DataFrame:
    names = ("lines", "headers", "short", "empty", "bad_time", "bad_number")
    return sensors.sensor_file_report(s, _sensor_files(s, d), "txt").agg(*[F.sum(n).alias(n) for n in names])


@query("read_line_vertices", "", f"WITH {VERTICES}, lw AS (SELECT line_id, 'line ' || line_id AS name, CASE WHEN line_id % 2 = 0 THEN line_id / 4.0::DOUBLE END AS width FROM (SELECT DISTINCT line_id FROM lv)) SELECT line_id, seq, round(x, 6) AS lon, round(y, 6) AS lat, name, width FROM lv JOIN lw USING (line_id)")
def _vertices(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    points = line_vertices(s, d).groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.array("x", "y").alias("p")))).alias("g"))
    properties = F.struct(c("line_id").alias("id"), F.concat(F.lit("line "), c("line_id").cast("string")).alias("name"), F.when(c("line_id") % 2 == 0, F.translate((c("line_id") / 4).cast("string"), ".", ",")).alias("width"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("LineString").alias("type"), c("g.p").alias("coordinates")).alias("geometry"))
    path = f"{shared_folder(s)}/files/lines-{uuid.uuid4().hex}"
    points.select(F.to_json(feature).alias("value")).write.text(path)
    return rounded(vectors.read_line_vertices(s, path, "id"), "lon", "lat")
