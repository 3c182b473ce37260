"""Least-cost distances and paths over grids, by tiles: a tile is settled in one task, and only its border goes on.

cost: row, col, cost (not negative). A step goes to one of eight neighbours.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import D8
from .supersteps import stored

#: Cells of a tile's side: what meets in a task.
TILE = 128
#: So many rounds of changes are put together, so that a round doesn't read all rounds before it.
ROUNDS = 8
STEPS = [(dr, dc, math.hypot(dr, dc)) for dr, dc, _ in D8]
STATE = "row int, col int, cost double, dist double, back int"


def _tile(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("int")


def _in_tiles(df: DataFrame, size: int) -> DataFrame:
    return df.withColumns({"tr": _tile(F.col("row"), size), "tc": _tile(F.col("col"), size)})


def _settle(size: int, mean: bool):
    """Relaxes a tile from what its own cells and the cells around it hold (kind 0: its own, 1: around it, 2: a source)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["tr"].iloc[0]) * size - 1, int(pdf["tc"].iloc[0]) * size - 1
        cost, dist, back = np.full((size + 2, size + 2), np.inf), np.full((size + 2, size + 2), np.inf), np.full((size + 2, size + 2), -1, np.int32)
        for kind in (0, 1, 2):
            g = pdf[pdf["kind"] == kind]
            r, c = g["row"].to_numpy(np.int64) - r0, g["col"].to_numpy(np.int64) - c0
            if kind < 2:
                cost[r, c], dist[r, c] = g["cost"].to_numpy(float), g["dist"].fillna(np.inf).to_numpy(float)
                back[r, c] = g["back"].fillna(-1).to_numpy(np.int32)
            else:
                dist[r, c], back[r, c] = 0.0, -1
            if kind:
                seeds = list(zip(dist[r, c].tolist(), r.tolist(), c.tolist())) + (seeds if kind == 2 else [])
        seeds = [s for s in seeds if s[0] < np.inf and np.isfinite(cost[s[1], s[2]])]
        heapq.heapify(seeds)
        changed = {(r, c) for _, r, c in seeds if 0 < r <= size and 0 < c <= size}
        price, far, from_, pop, push = cost.tolist(), dist.tolist(), back.tolist(), heapq.heappop, heapq.heappush
        while seeds:
            d, r, c = pop(seeds)
            if d > far[r][c]:
                continue
            for i, (dr, dc, length) in enumerate(STEPS):
                y, x = r + dr, c + dc
                if 0 < y <= size and 0 < x <= size:
                    new = d + ((price[r][c] + price[y][x]) / 2 * length if mean else price[y][x])
                    if new < far[y][x]:
                        far[y][x], from_[y][x] = new, (i + 4) % 8  # the way back is the opposite direction
                        changed.add((y, x))
                        push(seeds, (new, y, x))
        rows = [(y + r0, x + c0, price[y][x], far[y][x], from_[y][x]) for y, x in changed if price[y][x] < np.inf]
        return pd.DataFrame(rows, columns=["row", "col", "cost", "dist", "back"]).astype({"row": "int32", "col": "int32", "back": "int32"})

    return run


def cost_distance(cost: DataFrame, sources: DataFrame, tile: int = TILE, mean: bool = True, progress: list | None = None) -> DataFrame:
    """row, col, cost, dist, back: least cost from the nearest source (row, col), and the way back.

    mean: a step costs its length times the mean of both cells' costs; else the cost of the cell it enters. back is the
    place in D8 of the direction to the cell before, -1 at a source; cells that no source reaches are left
    out, and so are sources without a cell. Tiles that hear of a nearer border cell are settled again by a heap; so rounds
    follow the tiles that a path crosses, not its cells. progress: takes the number of tiles of each round.
    """
    blank = lambda t, v: F.lit(v).cast(t)
    base = stored(_in_tiles(cost.where("cost is not null").select("row", "col", "cost"), tile), "cost-cells")
    news = _in_tiles(sources.select("row", "col").distinct(), tile).select("tr", "tc", "row", "col", blank("double", None).alias("cost"), F.lit(0.0).alias("dist"), F.lit(-1).alias("back"), F.lit(2).alias("kind"))
    known: list[DataFrame] = []
    around = F.explode(F.array(*[F.struct(_tile(F.col("row") + dr, tile).alias("tr"), _tile(F.col("col") + dc, tile).alias("tc")) for dr, dc, _ in STEPS])).alias("t")
    while True:
        news = stored(news, "cost-news")
        active = news.select("tr", "tc").distinct()
        if progress is not None:
            progress.append(active.count())
        own = base.join(active, ["tr", "tc"], "left_semi")
        if known:
            told = known[0]
            for k in known[1:]:
                told = told.unionByName(k)
            told = told.join(active, ["tr", "tc"], "left_semi").groupBy("row", "col").agg(F.min_by(F.struct("dist", "back"), "dist").alias("b"))
            own = own.join(told, ["row", "col"], "left").select("tr", "tc", "row", "col", "cost", "b.dist", "b.back")
        else:
            own = own.select("tr", "tc", "row", "col", "cost", blank("double", None).alias("dist"), blank("int", None).alias("back"))
        both = own.withColumn("kind", F.lit(0)).unionByName(news)
        changed = stored(_in_tiles(both.groupBy("tr", "tc").applyInPandas(_settle(tile, mean), STATE), tile), "cost-changed")
        if changed.isEmpty():
            break
        known.append(changed)
        if len(known) > ROUNDS:
            told = known[0]
            for k in known[1:]:
                told = told.unionByName(k)
            known = [stored(told.groupBy("row", "col").agg(F.min_by(F.struct("tr", "tc", "cost", "dist", "back"), "dist").alias("b")).select("row", "col", "b.*"), "cost-known")]
        edge = changed.select(F.col("tr").alias("own_r"), F.col("tc").alias("own_c"), "row", "col", "cost", "dist", "back", around)
        news = edge.where("t.tr <> own_r or t.tc <> own_c").select("t.tr", "t.tc", "row", "col", "cost", "dist", "back").distinct().withColumn("kind", F.lit(1))
        news = news.join(base.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
    if not known:
        return base.select("row", "col", "cost", F.lit(0.0).alias("dist"), F.lit(-1).alias("back")).limit(0)
    told = known[0]
    for k in known[1:]:
        told = told.unionByName(k)
    return told.groupBy("row", "col").agg(F.min_by(F.struct("cost", "dist", "back"), "dist").alias("b")).select("row", "col", "b.*")


def _follow(size: int):
    """Walks the paths that are in a tile back to a source, or to the first cell of another tile (on)."""

    def run(key, walkers: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        way = {(r, c): (b, d) for r, c, b, d in zip(cells["row"].tolist(), cells["col"].tolist(), cells["back"].tolist(), cells["dist"].tolist())}
        rows = []
        for i, seq, r, c in zip(walkers["id"].tolist(), walkers["seq"].tolist(), walkers["row"].tolist(), walkers["col"].tolist()):
            while (r, c) in way:
                b, d = way[r, c]
                rows.append((i, seq, r, c, d, False))
                if b < 0:
                    break
                r, c, seq = r + STEPS[b][0], c + STEPS[b][1], seq + 1
            else:
                if (r // size, c // size) != tuple(key):
                    rows.append((i, seq, r, c, None, True))
        return pd.DataFrame(rows, columns=["id", "seq", "row", "col", "dist", "on"])

    return run


def cost_paths(distances: DataFrame, ends: DataFrame, tile: int = TILE) -> DataFrame:
    """id, seq, row, col, dist: the cells from each end (id, row, col; seq 0) back to its source, as cost_distance tells them.

    A round takes each path through one tile, so rounds follow the tiles that it crosses. Ends that no source reaches have no rows.
    """
    state = stored(_in_tiles(distances.select("row", "col", "dist", "back"), tile), "path-state")
    walkers, out = stored(_in_tiles(ends.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("seq"), "row", "col"), tile), "path-ends"), None
    while not walkers.isEmpty():
        here = state.join(walkers.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        moved = walkers.groupBy("tr", "tc").cogroup(here.groupBy("tr", "tc")).applyInPandas(_follow(tile), "id long, seq int, row int, col int, dist double, on boolean")
        moved = stored(moved, "path-cells")
        part = moved.where("not on").drop("on")
        out = part if out is None else out.unionByName(part)
        walkers = _in_tiles(moved.where("on").select("id", "seq", "row", "col"), tile)
    return out if out is not None else state.select(F.lit(0).cast("long").alias("id"), F.lit(0).alias("seq"), "row", "col", "dist").limit(0)


def building_costs(cells: DataFrame, start: tuple[int, int], ratio: float = 1.2, building: float = 1e3) -> DataFrame:
    """row, col, cost, building: costs of heights above the start's, times ratio: lower cells cost (z / 4)^2, higher ones are buildings.

    A cell at the threshold costs z^2; heights below 0 count as they are, as their squares do.
    """
    z = F.col("z")
    limit = cells.where((F.col("row") == start[0]) & (F.col("col") == start[1])).agg(F.max(z * ratio).alias("limit"))
    high = z > F.col("limit")
    return cells.join(F.broadcast(limit)).select("row", "col", F.when(high, building).when(z < F.col("limit"), F.pow(z / 4, F.lit(2))).otherwise(F.pow(z, F.lit(2))).alias("cost"), high.alias("building"))  # limit: one row


#: Cells of a tile's side for windows, and hours of a group.
WINDOW_TILE, HOURS = 64, 32


def _windows(side: int, halves: tuple[int, ...], ref: bool):
    """Sums around the places of a tile for the hours of a group."""
    far = max(halves)
    wide = side + 2 * far

    def around(a: np.ndarray, low: int, high: int) -> np.ndarray:
        for _ in range(2):  # rows, then columns: each sum is of cells alone, so no large sums cancel
            n = a.shape[1] - 2 * far
            a = sum((a[:, far + d : far + d + n] for d in range(low + 1, high + 1)), a[:, far + low : far + low + n]).swapaxes(1, 2)
        return a

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table, places: pa.Table) -> pa.Table:
        if not places.num_rows:
            cells = cells.slice(0, 0)
        r0, c0 = key[0].as_py() * side - far, key[1].as_py() * side - far
        hour = cells.column("ts").combine_chunks().dictionary_encode("encode")
        t, n = hour.indices.to_numpy(zero_copy_only=False), len(hour.dictionary)
        at = t, cells.column("row").to_numpy() - r0, cells.column("col").to_numpy() - c0
        known = ~cells.column("z").is_null().to_numpy()
        z = cells.column("z").to_numpy()[known]
        has, own = (np.zeros((n, wide, wide), bool) for _ in range(2))
        total, most = np.zeros((n, wide, wide)), np.full((n, wide, wide), -np.inf)
        has[at] = True
        at = tuple(x[known] for x in at)
        own[at] = True
        np.add.at(total, at, z)
        np.maximum.at(most, at, z)
        row, col = (places.column(c).to_numpy() for c in ("row", "col"))
        y, x = row - r0 - far, col - c0 - far
        hours, place = np.nonzero((around(has.astype(np.int32), -far, far) > 0)[:, y, x])
        told = {"ts": hour.dictionary.take(pa.array(hours)), "row": pa.array(row[place]), "col": pa.array(col[place])}
        there = hours, y[place] + far, x[place] + far
        told["r1x1"] = pa.array(most[there], mask=~own[there])
        for h in halves:
            told[f"r{2 * h + 1}x{2 * h + 1}"] = pa.array(around(total, -h, h - 1 if ref else h)[hours, y[place], x[place]])
        return pa.table(told)

    return run


def rain_at_stations(cells: DataFrame, points: DataFrame, halves: tuple[int, ...] = (1, 2, 3, 4), window: str = "ref") -> DataFrame:
    """station_id, ts, r1x1, r3x3 and so on: the cell under each station and sums around it, for each hour.

    cells: ts, row, col, z; points: station_id, row, col. ref: windows of half h hold offsets -h .. h - 1; centered: -h .. h.
    Cells that are missing, null or off the grid count as 0, and r1x1 is null there; a station has no row for an hour
    without a cell as near as the largest half. Windows are summed once for a place, however many stations are there, by tiles with the cells around
    them: a task holds a tile of some hours. A window is the sum of its own cells, not a difference of sums over many.
    """
    c, far = F.col, max(halves)
    tile = lambda v: F.floor(v / WINDOW_TILE).cast("long")
    blocks = max(1, math.ceil((cells.select("ts").distinct().count()) / HOURS))
    spots = points.select(c("row").cast("long").alias("row"), c("col").cast("long").alias("col")).where("row is not null and col is not null").distinct()
    spots = spots.select(tile(c("row")).alias("tr"), tile(c("col")).alias("tc"), "row", "col")
    reach = lambda v: F.explode(F.sequence(tile(c(v) - far), tile(c(v) + far)))
    held = cells.select("ts", c("row").cast("long").alias("row"), c("col").cast("long").alias("col"), c("z").cast("double").alias("z"), F.pmod(F.xxhash64("ts"), F.lit(blocks)).alias("block"))
    held = held.withColumn("tr", reach("row")).withColumn("tc", reach("col"))
    asked = spots.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    names = [f"r{2 * h + 1}x{2 * h + 1}" for h in halves]
    schema = f"ts {cells.schema['ts'].dataType.simpleString()}, row long, col long, r1x1 double, " + ", ".join(f"{n} double" for n in names)
    keys = ["tr", "tc", "block"]
    told = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_windows(WINDOW_TILE, halves, window == "ref"), schema)
    # Sizes of what comes out of cells aren't known, so neither side is broadcast.
    return points.select("station_id", c("row").cast("long").alias("row"), c("col").cast("long").alias("col")).join(told.hint("merge"), ["row", "col"]).select("station_id", "ts", "r1x1", *names)
