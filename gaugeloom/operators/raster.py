"""Grids as cell tables (row, col, z): neighbourhoods are equi-joins on shifted cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .supersteps import stored

#: Codes of the eight directions: east, then clockwise.
D8 = ((0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32), (-1, 0, 64), (-1, 1, 128))


def gps_to_cell(points: DataFrame, top: float, left: float, bottom: float, right: float, height: int, width: int) -> DataFrame:
    """Row and column by linear position between the corners, cut toward zero."""
    return points.withColumns({"row": ((F.col("lat") - top) / (bottom - top) * height).cast("int"), "col": ((F.col("lon") - left) / (right - left) * width).cast("int")})


def downsample(cells: DataFrame, f: int) -> DataFrame:
    """Mean of f x f blocks; blocks that aren't whole go."""
    g = cells.groupBy(F.floor(F.col("row") / f).cast("int").alias("row"), F.floor(F.col("col") / f).cast("int").alias("col")).agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == f * f).select("row", "col", "z")


def crop(cells: DataFrame, r0: int, c0: int, r1: int, c1: int, margin: int = 0) -> DataFrame:
    return cells.where(F.col("row").between(min(r0, r1) - margin, max(r0, r1) + margin) & F.col("col").between(min(c0, c1) - margin, max(c0, c1) + margin))


def merge_tiles(tiles: DataFrame) -> DataFrame:
    """Cells (tile, row, col, z) of several tiles; the first tile wins."""
    return tiles.groupBy("row", "col").agg(F.min_by("z", "tile").alias("z"))


def window_sums(cells: DataFrame, points: DataFrame, half: int, window: str = "ref") -> DataFrame:
    """Sum of the cells around each point (station_id, row, col). ref: offsets -half .. half - 1; centered: -half .. half."""
    high = half - 1 if window == "ref" else half
    side = F.sequence(F.lit(-half), F.lit(high))
    wide = points.select("station_id", F.explode(F.transform(side, lambda d: F.col("row") + d)).alias("row"), "col").select("station_id", "row", F.explode(F.transform(side, lambda d: F.col("col") + d)).alias("col"))
    return wide.join(cells, ["row", "col"]).groupBy("station_id").agg(F.sum("z").alias("total"))


def slope_degrees(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """Slope: central differences inside, one-sided at the border."""

    def gradient(part: str, order: str):
        w = Window.partitionBy(part).orderBy(order)
        a, b = F.lag("z").over(w), F.lead("z").over(w)
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), (b - F.col("z")) / size).when(b.isNull(), (F.col("z") - a) / size).otherwise((b - a) / (2 * size))

    g = cells.withColumn("gx", gradient("row", "col"))
    g = g.withColumn("gy", gradient("col", "row"))
    return g.select("row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope"))


#: Cells of a tile's side: what meets in a task, with the cells around it.
TILE = 128


def _medians(side: int, half: int):
    """Medians around the own cells of a tile; cells that are there twice count twice."""
    wide = side + 2 * half

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        r0, c0 = key[0].as_py() * side - half, key[1].as_py() * side - half
        row, col, own, seen = (cells.column(c).to_numpy() for c in ("row", "col", "own", "seen"))
        null = cells.column("z").is_null().to_numpy()
        z = cells.column("z").to_numpy()
        y, x = row - r0, col - c0
        mine = own & (y >= half) & (y < half + side) & (x >= half) & (x < half + side)
        place = np.unique(y[mine] * wide + x[mine])
        py, px = place // wide - half, place % wide - half
        at = np.flatnonzero(seen)
        at = at[np.argsort(y[at] * wide + x[at], kind="stable")]
        where = y[at] * wide + x[at]
        nth = np.arange(len(at)) - np.searchsorted(where, where)
        around, there, known = [], 0, 0
        window = lambda a: np.lib.stride_tricks.sliding_window_view(a.reshape(wide, wide), (2 * half + 1, 2 * half + 1))[py, px].reshape(len(place), (2 * half + 1) ** 2)
        for k in range(int(nth.max(initial=-1)) + 1):  # one layer, unless cells repeat
            i = nth == k
            values, has, real = np.full(wide * wide, np.nan), np.zeros(wide * wide, bool), np.zeros(wide * wide, bool)
            has[where[i]], real[where[i]] = True, ~null[at[i]]
            values[where[i]] = np.where(null[at[i]], np.nan, z[at[i]])
            around.append(window(values))
            there, known = there + window(has).sum(axis=1), known + window(real).sum(axis=1)
        if not around:
            place, out, known = place[:0], np.zeros(0), np.zeros(0, int)
        else:
            ordered = np.sort(np.concatenate(around, axis=1), axis=1)  # what isn't there comes last
            middle = (np.maximum(known, 1) - 1) / 2
            low, high = (np.take_along_axis(ordered, f(middle).astype(int)[:, None], axis=1)[:, 0] for f in (np.floor, np.ceil))
            ok = there > 0
            place, out, known = place[ok], np.where(low == high, low, low / 2 + high / 2)[ok], known[ok]
        return pa.table({"row": pa.array(place // wide + r0, pa.int32()), "col": pa.array(place % wide + c0, pa.int32()), "z": pa.array(out, pa.float64(), mask=known == 0)})

    return run


def median_filter(cells: DataFrame, size: int = 5) -> DataFrame:
    """Median of size x size cells, the grid (rows and columns from 0) reflected at its border.

    A tile meets in one task with the cells around it, which stand at the place where they are seen; so a cell
    is told to few tiles, not to each of the cells around it.
    """
    c, half = F.col, size // 2
    e = cells.agg(*[f(v) for v in ("row", "col") for f in (F.min, F.max)]).first()

    def places(v: str, least: int, most: int):
        """Where a cell is seen along one side: at its own place, and mirrored at the border."""
        x = c(v).cast("long")
        seen = F.array(F.struct(x.alias("at"), F.lit(True).alias("own"), (x >= 0).alias("seen")), *[F.struct(y.alias("at"), F.lit(False).alias("own"), ok.alias("seen")) for y, ok in ((-x - 1, x >= 0), (2 * most + 1 - x, x <= most))])
        return F.explode(F.filter(seen, lambda p: p["own"] | p["seen"] & p["at"].between(least - half, most + half)))

    if e[0] is None or e[2] is None:
        return cells.select("row", "col", c("z").cast("double").alias("z")).limit(0)
    tiles = lambda at: F.explode(F.sequence(F.floor((at - half) / TILE), F.floor((at + half) / TILE)))
    wide = cells.select(places("row", e[0], e[1]).alias("r"), "col", "z").select("r", places("col", e[2], e[3]).alias("c"), "z")
    wide = wide.select(c("r.at").alias("row"), c("c.at").alias("col"), (c("r.own") & c("c.own")).alias("own"), (c("r.seen") & c("c.seen")).alias("seen"), c("z").cast("double").alias("z"))
    wide = wide.withColumn("tr", tiles(c("row"))).withColumn("tc", tiles(c("col")))
    return wide.groupBy("tr", "tc").applyInArrow(_medians(TILE, half), "row int, col int, z double")


def d8_direction(cells: DataFrame) -> DataFrame:
    """Code of the lowest of the eight neighbours, if it is lower; 0 at sinks and at the border (fewer than eight neighbours)."""
    around = F.explode(F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(i).alias("i"), F.lit(code).alias("code")) for i, (dr, dc, code) in enumerate(D8)]))
    told = cells.select("row", "col", "z", around.alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"), F.struct("z", "o.i", "o.code").alias("n"))
    low = told.groupBy("row", "col").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("k"))
    code = F.when((F.col("k") == 8) & (F.col("n.z") < F.col("z")), F.col("n.code")).otherwise(F.lit(0))
    return cells.join(low, ["row", "col"], "left").select("row", "col", F.coalesce(code, F.lit(0)).alias("dir"))


def flow_targets(directions: DataFrame) -> DataFrame:
    """row, col and the cell that it drains into (to_row, to_col; none for direction 0)."""
    to = lambda k: F.coalesce(*[F.when(F.col("dir") == d[2], F.col("row" if k == 0 else "col") + d[k]) for d in D8])
    return directions.select("row", "col", to(0).alias("to_row"), to(1).alias("to_col"))


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """How many cells drain through each cell, itself included, by pointer doubling.

    Each round, cells pass their sums on 2^k steps downstream: a logarithm of the longest path in rounds.
    """
    state = stored(flow_targets(directions).withColumn("acc", F.lit(1).cast("long")), "flow")
    while True:
        given = state.where("to_row is not null").groupBy("to_row", "to_col").agg(F.sum("acc").alias("more"))
        if given.isEmpty():
            return state.select("row", "col", "acc")
        ahead = state.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("n_row"), F.col("to_col").alias("n_col"))
        moved = state.join(ahead, ["to_row", "to_col"], "left").select("row", "col", F.col("n_row").alias("to_row"), F.col("n_col").alias("to_col"), "acc")
        got = given.withColumnsRenamed({"to_row": "row", "to_col": "col"})
        state = stored(moved.join(got, ["row", "col"], "left").select("row", "col", "to_row", "to_col", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), "flow")


def threshold_mask(cells: DataFrame, ratio: float) -> DataFrame:
    """Cells lower than ratio times the mean."""
    mean = cells.agg(F.avg("z").alias("mean"))
    return cells.join(F.broadcast(mean)).where(F.col("z") < ratio * F.col("mean")).select("row", "col")  # mean: one row


def _beside(cells: DataFrame, offsets) -> DataFrame:
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
    return cells.select("row", "col", o.alias("o")).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))


def corridor(path: DataFrame, width: int) -> DataFrame:
    """Cells within so many steps of a path."""
    return _beside(path, [(a, b) for a in range(-width, width + 1) for b in range(-width, width + 1) if abs(a) + abs(b) <= width]).distinct()


def flood_fill(seed: DataFrame, allowed: DataFrame) -> DataFrame:
    """Allowed cells that a seed reaches over shared edges: components of adjacent cells, a logarithm of their extent in rounds."""
    key = F.shiftleft(F.col("row").cast("long"), 32) + F.col("col").cast("long")
    cells = allowed.select("row", "col").distinct().withColumn("node", key)
    src = cells.select(F.col("node").alias("src"), F.explode(F.array(F.struct("row", "col"), F.struct("row", (F.col("col") + 1).alias("col")), F.struct((F.col("row") + 1).alias("row"), "col"))).alias("o"))
    edges = src.select("src", (F.shiftleft(F.col("o.row").cast("long"), 32) + F.col("o.col").cast("long")).alias("dst")).join(cells.select(F.col("node").alias("dst")), "dst", "left_semi")
    found = stored(components(edges), "flood")
    hit = found.join(seed.select(key.alias("node")), "node", "left_semi").select("label").distinct()
    reached = found.join(hit, "label", "left_semi").select("node")
    return cells.join(reached, "node", "left_semi").select("row", "col")


def cost_surface(cells: DataFrame, threshold: float) -> DataFrame:
    return cells.select("row", "col", F.when(F.col("z") < threshold, F.pow(F.col("z") / 4, 2)).otherwise(F.pow("z", F.lit(2))).alias("cost"))


def cost_distance(cost: DataFrame, sources: DataFrame) -> DataFrame:
    """Least sum of costs over eight-neighbour steps from the nearest source, by rounds of relaxation."""
    offsets = [(a, b) for a, b, _ in D8]
    best = frontier = stored(sources.select("row", "col").distinct().withColumn("dist", F.lit(0.0)), "cost")
    while not frontier.isEmpty():
        o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets]))
        out = frontier.select("dist", "row", "col", o.alias("o")).select("dist", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))
        new = out.join(cost, ["row", "col"]).groupBy("row", "col").agg(F.min(F.col("dist") + F.col("cost")).alias("new"))
        both = stored(best.join(new, ["row", "col"], "full_outer"), "cost")
        frontier = stored(both.where(F.col("dist").isNull() | (F.col("new") < F.col("dist"))).select("row", "col", F.col("new").alias("dist")), "cost")
        best = stored(both.select("row", "col", F.least("dist", "new").alias("dist")), "cost")
    return best


def line_cells(lines: DataFrame) -> DataFrame:
    """Cells on the straight line from (r0, c0) to (r1, c1): id, seq, row, col."""
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")), F.lit(1))
    wide = lines.withColumn("n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), n)))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("seq") / F.col("n") + 0.5).cast("int")
    return wide.select("id", "seq", at("r0", "r1").alias("row"), at("c0", "c1").alias("col"))


def affine_to_cell(points: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """Row and column of each point (lon, lat) by the inverse of an affine transform, rounded down."""
    return points.withColumns({"row": F.floor((F.col("lat") - y0) / dy).cast("int"), "col": F.floor((F.col("lon") - x0) / dx).cast("int")})


def cell_to_gps(cells: DataFrame, x0: float, y0: float, dx: float, dy: float) -> DataFrame:
    """lon and lat of each cell's centre."""
    return cells.withColumns({"lon": x0 + (F.col("col") + 0.5) * dx, "lat": y0 + (F.col("row") + 0.5) * dy})


def mosaic(tiles: DataFrame, f: int) -> DataFrame:
    """Means of f x f blocks of each tile (tile, row, col, z) on one coarse grid; where tiles overlap, the last tile counts."""
    coarse = tiles.where("z is not null").groupBy("tile", F.floor(F.col("row") / f).cast("int").alias("row"), F.floor(F.col("col") / f).cast("int").alias("col")).agg(F.avg("z").alias("z"))
    return coarse.groupBy("row", "col").agg(F.max_by("z", "tile").alias("z"))


def sample_along(path: DataFrame, cells: DataFrame) -> DataFrame:
    """Values of the cells on each path (id, seq, row, col); places outside the grid go."""
    return path.join(cells.select("row", "col", "z"), ["row", "col"]).select("id", "seq", "z")


def edge_profile(path: DataFrame, cells: DataFrame, slope: DataFrame) -> DataFrame:
    """Elevation and slope along each path: mean, std, min, max and median of z, mean slope, difference of the end's z, -1 where nothing is known."""
    along = path.select("id", "seq", "row", "col").join(cells.select("row", "col", "z"), ["row", "col"], "left").join(slope.select("row", "col", "slope"), ["row", "col"], "left")
    out = along.groupBy("id").agg(
        F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.min("z").alias("min"), F.max("z").alias("max"), F.median("z").alias("median"), F.avg("slope").alias("slope"),
        (F.max_by("z", F.when(F.col("z").isNotNull(), F.col("seq"))) - F.min_by("z", F.when(F.col("z").isNotNull(), F.col("seq")))).alias("dz"),
    )
    return out.select("id", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("mean", "std", "min", "max", "median", "slope", "dz")])
