"""Nearest lines: points and the stretches of lines that their boxes touch meet in cells, and a cell is searched in one task.

lines: line_id, lat1, lon1, lat2, lon2. Not across 180 degrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EARTH_KM
from .supersteps import stored

#: Points and segments of a cell that meet in one task; a cell with more is split into blocks of both.
POINTS, SEGMENTS = 20_000, 20_000
#: Cells whose first vertices stand for all of them when distances are bounded; at most three times as many occur.
STANDS = 1 << 14
#: Pairs that are compared at once.
PAIRS = 16_384


def box(km: Column) -> tuple[Column, Column]:
    """Half the height and width, in degrees, of a box around (lat, lon) that holds all places so near."""
    angle = F.degrees(F.asin(F.least(km / EARTH_KM, F.lit(1.0)))) * (1 + 1e-9) + 1e-9
    high = F.least(F.abs("lat") + angle, F.lit(89.9))  # how wide a degree of longitude is at the box's end nearest to a pole
    return angle, F.least(angle / F.cos(F.radians(high)), F.lit(360.0))


def _ecef(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return EARTH_KM * np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)])


def _km(p: np.ndarray, a: np.ndarray, ab: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Distances of points from segments, as point_segment_km tells them; arrays of x, y, z that broadcast."""
    ap = p - a
    t = ap[0] * ab[0] + ap[1] * ab[1] + ap[2] * ab[2]
    t = np.clip(np.divide(t, square, out=np.zeros_like(t), where=square > 0), 0.0, 1.0)
    x, y, z = (ap[i] - t * ab[i] for i in range(3))
    return np.sqrt(x * x + y * y + z * z)


def nearest_of(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each point (columns of x, y, z) the first nearest segment and its distance; and how many pairs were compared.

    Of all points inside a ball, none is nearer to a segment than to the one nearest to the ball's centre if
    that is farther by more than the ball's width; so points are halved, and each half keeps the segments that remain.
    """
    ab = b - a
    square = ab[0] * ab[0] + ab[1] * ab[1] + ab[2] * ab[2]
    best, far, compared = np.zeros(points.shape[1], np.int64), np.full(points.shape[1], np.inf), 0
    todo = [(np.arange(points.shape[1]), np.arange(a.shape[1]))]
    while todo:
        mine, near = todo.pop()
        if len(mine) * len(near) <= PAIRS or len(mine) == 1:
            km = _km(points[:, mine, None], a[:, None, near], ab[:, None, near], square[None, near])
            first = km.argmin(axis=1)
            best[mine], far[mine] = near[first], km[np.arange(len(mine)), first]
            compared += km.size
            continue
        p = points[:, mine]
        low, high = p.min(axis=1), p.max(axis=1)
        centre = (low + high) / 2
        reach = np.sqrt(((p - centre[:, None]) ** 2).sum(axis=0).max())
        km = _km(centre[:, None], a[:, near], ab[:, near], square[near])
        compared += len(near)
        near = near[km <= km.min() + 2 * reach + 1e-6]
        half, side = len(mine) // 2, int(np.argmax(high - low))
        order = np.argpartition(p[side], half)
        todo += [(mine[order[:half]], near), (mine[order[half:]], near)]
    return best, far, compared


def bounded(points: DataFrame, lines: DataFrame) -> DataFrame:
    """station_id, lat, lon and bound: km to a vertex of a line, not farther than the nearest one by more than a cell of a grid of fixed size.

    Points without a place, and all if there are no lines, have no rows. The grid's vertices, one a cell, go to all tasks.
    """
    c, spark = F.col, lines.sparkSession
    whole = lines.where("lat1 > double('-inf') and lat1 < double('inf') and lon1 > double('-inf') and lon1 < double('inf')")  # which is false for nan, too
    e = whole.agg(F.min("lat1"), F.max("lat1"), F.min("lon1"), F.max("lon1")).first()
    schema = f"station_id {points.schema['station_id'].dataType.simpleString()}, lat double, lon double, bound double"
    if e[0] is None:
        return spark.createDataFrame([], schema)
    high, wide = e[1] - e[0], e[3] - e[2]
    size = max((high * wide / STANDS) ** 0.5, high / STANDS, wide / STANDS, 1e-9)
    place = [F.floor((c(v) - low) / size) for v, low in (("lat1", e[0]), ("lon1", e[2]))]
    ends = whole.groupBy(*place).agg(F.min(F.struct("lat1", "lon1")).alias("v")).select("v.lat1", "v.lon1").toArrow()
    stands = spark.sparkContext.broadcast(_ecef(*(ends.column(v).to_numpy() for v in ("lat1", "lon1"))))  # of bounded size

    def run(batches):
        v = stands.value
        for b in batches:
            lat, lon = (b.column(x).to_numpy(zero_copy_only=False) for x in ("lat", "lon"))
            keep = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
            if len(keep):
                _, km, _ = nearest_of(_ecef(lat[keep], lon[keep]), v, v)
                yield pa.RecordBatch.from_arrays([b.column("station_id").take(pa.array(keep)), pa.array(lat[keep]), pa.array(lon[keep]), pa.array(km)], ["station_id", "lat", "lon", "bound"])

    return points.select("station_id", c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon")).mapInArrow(run, schema)


def _search(key: tuple[pa.Scalar, ...], points: pa.Table, lines: pa.Table) -> pa.Table:
    lines = lines.sort_by("line_id")  # of equally near ones, the smaller id
    side = lambda t, lat, lon: _ecef(t.column(lat).to_numpy(), t.column(lon).to_numpy())
    p, a, b = side(points, "lat", "lon"), side(lines, "lat1", "lon1"), side(lines, "lat2", "lon2")
    real, whole = np.flatnonzero(np.isfinite(p).all(axis=0)), np.flatnonzero(np.isfinite(a + b).all(axis=0))
    if not len(whole):
        real = real[:0]
    if len(real):
        best, km, _ = nearest_of(p[:, real], a[:, whole], b[:, whole])
    else:
        best, km = np.zeros(0, np.int64), np.zeros(0)
    return pa.table({"station_id": points.column("station_id").take(pa.array(real)), "line_id": lines.column("line_id").take(pa.array(whole[best] if len(best) else best)), "km": pa.array(km)})


def nearest_in_boxes(points: DataFrame, lines: DataFrame, cell: float, name: str) -> DataFrame:
    """station_id, line_id, km: the nearest of the segments that come into each point's box (ties: the smaller line_id).

    points: station_id, lat, lon, and dy and dx, half the box's height and width. A point lies at the level of its box,
    whose cells double from level to level, in the at most four that the box touches. A segment lies in the cells
    that it crosses, not in all of its box, where there are points. Other segments
    may be told for points whose box none touches. Cells with many points or segments are split into blocks of both.
    """
    c = F.col
    level = F.greatest(F.ceil(F.log2(F.greatest(2 * F.greatest("dx", "dy"), F.lit(cell)) / cell)), F.lit(0)).cast("int")
    size = F.pow(F.lit(2.0), c("level")) * cell
    side = lambda v, d: F.explode(F.sequence(F.floor((c(v) - c(d)) / size), F.floor((c(v) + c(d)) / size)))
    asked = points.select("station_id", "lat", "lon", "dx", "dy", level.alias("level")).withColumn("cx", side("lon", "dx")).withColumn("cy", side("lat", "dy"))
    asked = stored(asked.select("station_id", "lat", "lon", "level", "cx", "cy"), f"{name}-asked")
    keys = ["level", "cx", "cy"]
    full = stored(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("p")), f"{name}-cells")
    levels = sorted(r.level for r in full.select("level").distinct().collect())  # powers of two: a dozen or so
    # Segments are great circles: long ones bulge out of the straight line between their ends.
    dx, dy = c("lon2") - c("lon1"), c("lat2") - c("lat1")
    extent = F.greatest(F.abs(dx), F.abs(dy))
    pad = extent * extent * 0.005 / F.cos(F.radians(F.least(F.greatest(F.abs("lat1"), F.abs("lat2")), F.lit(89.9)))) + 1e-9
    held = lines.select("line_id", "lat1", "lon1", "lat2", "lon2", pad.alias("pad"), F.explode(F.array(*map(F.lit, levels or [0]))).alias("level"))
    held = held.withColumn("cx", F.explode(F.sequence(F.floor((F.least("lon1", "lon2") - c("pad")) / size), F.floor((F.greatest("lon1", "lon2") + c("pad")) / size))))
    part = lambda x: F.when(F.abs(dx) > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - c("lon1")) / dx)))
    one, two = F.coalesce(part(c("cx") * size - c("pad")), F.lit(0.0)), F.coalesce(part((c("cx") + 1) * size + c("pad")), F.lit(1.0))
    held = held.withColumns({"y1": c("lat1") + one * dy, "y2": c("lat1") + two * dy})
    held = held.withColumn("cy", F.explode(F.sequence(F.floor((F.least("y1", "y2") - c("pad")) / size), F.floor((F.greatest("y1", "y2") + c("pad")) / size)))).drop("pad", "y1", "y2")
    counts = held.join(full, keys).groupBy(*keys).agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("s"))
    blocks = lambda v, most: F.ceil(c(v) / most).cast("long").alias(v)
    counts = stored(counts.select(*keys, blocks("p", POINTS), blocks("s", SEGMENTS)), f"{name}-counts")
    every = lambda v: F.explode(F.sequence(F.lit(0).cast("long"), c(v) - 1))
    here = asked.join(counts, keys).withColumn("pb", F.pmod(F.xxhash64("station_id"), c("p"))).withColumn("sb", every("s"))
    there = held.join(counts, keys).withColumn("sb", F.pmod(F.xxhash64("lat1", "lon1", "lat2", "lon2"), c("s"))).withColumn("pb", every("p"))
    group = [*keys, "pb", "sb"]
    ids = f"station_id {points.schema['station_id'].dataType.simpleString()}, line_id {lines.schema['line_id'].dataType.simpleString()}, km double"
    found = here.select(*group, "station_id", "lat", "lon").groupBy(*group).cogroup(there.select(*group, "line_id", "lat1", "lon1", "lat2", "lon2").groupBy(*group)).applyInArrow(_search, ids)
    return found.groupBy("station_id").agg(F.min(F.struct("km", "line_id")).alias("b")).select("station_id", "b.line_id", "b.km")
