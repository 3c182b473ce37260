"""Nearest neighbours, relational division, lookups."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import nearest
from .supersteps import globally_ranked, stored


def _in_cells(df: DataFrame, cell: float) -> DataFrame:
    return df.withColumns({"cx": F.floor(F.col("lon") / cell), "cy": F.floor(F.col("lat") / cell)})


#: Rings grow by so much; beyond so many cells across, cells are looked up in blocks.
GROWTH, ACROSS = 4, 4


def knn_ref(query: DataFrame, ref: DataFrame, k: int, cell: float | None = None, exclude_same: bool = False, before: bool = False) -> DataFrame:
    """The k nearest of ref to each query point: station_id, nb_id, rank, dist (planar, in degrees; ties by id).

    Points fall into grid cells, by default such that one holds about k of ref. A query looks into the ring of cells around
    it, and then into wider rings, keeping the nearest so far, until the k-th is nearer than what lies
    beyond the rings or all of ref is seen. A ring is looked at once; wide ones go by blocks of cells, so a round
    costs a query some hundred rows at most, however far its neighbours are. No point meets all others
    unless it must. before: only neighbours of a smaller id.
    """
    c = F.col
    points = ref.select(c("station_id").alias("nb_id"), c("lat").alias("nb_lat"), c("lon").alias("nb_lon"))
    e = points.agg(F.count(F.lit(1)).alias("n"), F.min("nb_lat").alias("lat0"), F.max("nb_lat").alias("lat1"), F.min("nb_lon").alias("lon0"), F.max("nb_lon").alias("lon1")).first()
    if e["lat0"] is None:
        return query.select("station_id", c("station_id").alias("nb_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("dist")).limit(0)
    if cell is None:
        cell = max(math.sqrt(max(e["lat1"] - e["lat0"], 1e-9) * max(e["lon1"] - e["lon0"], 1e-9) * k / e["n"]), 1e-9)
    r = stored(points.withColumns({"rx": F.floor(c("nb_lon") / cell), "ry": F.floor(c("nb_lat") / cell)}), "knn-ref")
    low, high = ([math.floor(e[f"{v}{i}"] / cell) for v in ("lon", "lat")] for i in (0, 1))
    q = _in_cells(query.select("station_id", "lat", "lon"), cell)
    whole = F.greatest(c("cx") - low[0], high[0] - c("cx"), c("cy") - low[1], high[1] - c("cy"))  # the ring that sees all of ref
    pending, carried, done, old, ring = stored(q.withColumn("whole", whole), "knn-query"), None, None, -1, 1
    while True:
        block = max(1, ring // ACROSS)

        def side(at: str, i: int, ring: int = ring, block: int = block):
            a, b = F.greatest(F.floor((c(at) - ring) / block), F.lit(low[i] // block)), F.least(F.floor((c(at) + ring) / block), F.lit(high[i] // block))
            return F.explode(F.when(a <= b, F.sequence(a, b)))

        wide = pending.withColumn("tx", side("cx", 0)).withColumn("ty", side("cy", 1))
        near = wide.join(r.withColumns({"tx": F.floor(c("rx") / block), "ty": F.floor(c("ry") / block)}), ["tx", "ty"])
        near = near.where(F.greatest(F.abs(c("rx") - c("cx")), F.abs(c("ry") - c("cy"))).between(old + 1, ring))
        if exclude_same:
            near = near.where("station_id <> nb_id")
        if before:
            near = near.where("nb_id < station_id")
        near = near.select("station_id", "nb_id", F.sqrt(F.pow(c("lat") - c("nb_lat"), 2) + F.pow(c("lon") - c("nb_lon"), 2)).alias("dist"))
        near = near if carried is None else near.unionByName(carried)
        order = Window.partitionBy("station_id").orderBy("dist", "nb_id")
        top = stored(near.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k), "knn-top")
        seen = top.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("far"))
        ready = (c("whole") <= ring) | F.coalesce((c("n") == k) & (c("far") <= ring * cell), F.lit(False))
        left = stored(pending.join(seen, "station_id", "left").where(~ready).select(*pending.columns), "knn-pending")
        last = left.isEmpty()
        part = top if last else top.join(left.select("station_id"), "station_id", "left_anti")
        done = part if done is None else done.unionByName(part)
        if last:
            return done.select("station_id", "nb_id", c("rank").cast("int").alias("rank"), "dist")
        carried = top.join(left.select("station_id"), "station_id", "left_semi").select("station_id", "nb_id", "dist")
        pending, old, ring = left, ring, ring * GROWTH


def knn_self(stations: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    return knn_ref(stations, stations, k, cell, exclude_same=True)


def knn_predecessors(stations: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """The k nearest among stations of a smaller id."""
    return knn_ref(stations, stations, k, cell, before=True)


def common_weeks(weeks: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Weeks that a target and all its neighbours have."""
    need = neighbors.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))
    have = neighbors.join(weeks.withColumnRenamed("station_id", "nb_id"), "nb_id").groupBy("station_id", "week_idx").agg(F.countDistinct("nb_id").alias("m"))
    return have.join(need, "station_id").where("m = n").join(weeks, ["station_id", "week_idx"], "left_semi").select("station_id", "week_idx")


def global_common_weeks(weeks: DataFrame) -> DataFrame:
    total = weeks.agg(F.countDistinct("station_id").alias("n"))
    return weeks.groupBy("week_idx").agg(F.countDistinct("station_id").alias("m")).join(F.broadcast(total)).where("m = n").select("week_idx")  # total: one row


def covering_stations(weeks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stations that have all the wanted weeks."""
    total = wanted.agg(F.countDistinct("week_idx").alias("n"))
    return weeks.join(wanted, "week_idx", "left_semi").groupBy("station_id").agg(F.countDistinct("week_idx").alias("m")).join(F.broadcast(total)).where("m = n").select("station_id")  # total: one row


def overlapping_stations(weeks: DataFrame) -> DataFrame:
    """Stations that share a week with another one."""
    shared = weeks.groupBy("week_idx").agg(F.countDistinct("station_id").alias("n")).where("n > 1")
    return weeks.join(shared, "week_idx", "left_semi").select("station_id").distinct()


def entries_by_week(weeks: DataFrame) -> DataFrame:
    return weeks.groupBy("week_idx").agg(F.sort_array(F.collect_list("station_id")).alias("stations"))


def split_from_labels(stations: DataFrame, neighbors: DataFrame, train_clusters: list[int]) -> DataFrame:
    """train: members of the clusters and their neighbours; test: the rest."""
    members = stations.where(F.col("cluster").isin(train_clusters)).select("station_id")
    train = members.union(neighbors.join(members, "station_id", "left_semi").select("nb_id")).distinct()
    rest = stations.select("station_id").join(train, "station_id", "left_anti")
    return train.withColumn("role", F.lit("train")).union(rest.withColumn("role", F.lit("test")))


def subset_with_neighbors(selected: DataFrame, neighbors: DataFrame) -> DataFrame:
    return selected.select("station_id").union(neighbors.join(selected, "station_id", "left_semi").select("nb_id")).distinct()


def train_test_overlap(a: DataFrame, b: DataFrame, digits: int = 7) -> DataFrame:
    """Places of both, the first only, the second only, by rounded coordinates."""
    at = lambda d: d.select(F.round("lat", digits).alias("lat"), F.round("lon", digits).alias("lon")).distinct()
    both = at(a).withColumn("in_a", F.lit(True)).join(at(b).withColumn("in_b", F.lit(True)), ["lat", "lon"], "full_outer")
    side = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "first").otherwise("second")
    return both.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def point_in_tile(points: DataFrame, tiles: DataFrame, cell: float = 1.0) -> DataFrame:
    """The first tile (by name) that holds each point, by a join on grid cells and an exact test."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    t = tiles.withColumn("cx", F.explode(span("minlon", "maxlon"))).withColumn("cy", F.explode(span("minlat", "maxlat")))
    inside = F.col("lon").between(F.col("minlon"), F.col("maxlon")) & F.col("lat").between(F.col("minlat"), F.col("maxlat"))
    found = _in_cells(points, cell).join(t, ["cx", "cy"]).where(inside)
    return found.groupBy("station_id").agg(F.min("tile").alias("tile"))


def raster_lookup(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Value of the cell under each point (row, col); none outside."""
    return points.join(cells.select("row", "col", "z"), ["row", "col"], "left")


def edge_lookup(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Distance of a pair: its forward row (dir -1), else the reverse row (dir 1), else -1 (dir 0)."""
    f = stats.select(F.col("src").alias("station_id"), F.col("dst").alias("nb_id"), F.col("distance").alias("df"))
    b = stats.select(F.col("dst").alias("station_id"), F.col("src").alias("nb_id"), F.col("distance").alias("db"))
    j = pairs.join(f, ["station_id", "nb_id"], "left").join(b, ["station_id", "nb_id"], "left")
    return j.select("station_id", "nb_id", F.coalesce("df", "db", F.lit(-1.0)).alias("distance"), F.when(F.col("df").isNotNull(), -1).when(F.col("db").isNotNull(), 1).otherwise(0).alias("dir"))


def align_methods(pred: DataFrame, a: str, b: str) -> DataFrame:
    """Samples of two methods side by side; stations whose lengths differ go."""
    x = pred.where(F.col("method") == a).select("station_id", "pos", "tgt", F.col("out").alias("out_a"))
    y = pred.where(F.col("method") == b).select("station_id", "pos", F.col("out").alias("out_b"))
    n = pred.where(F.col("method").isin(a, b)).groupBy("station_id").pivot("method", [a, b]).count()
    return x.join(y, ["station_id", "pos"]).join(n.where(F.col(a) == F.col(b)), "station_id", "left_semi")


def order_by_coord_sum(stations: DataFrame) -> DataFrame:
    """station_id and its place in the order of lat + lon, from 0."""
    ranked = globally_ranked(stations.select("station_id", (F.col("lat") + F.col("lon")).alias("s")), [F.col("s"), F.col("station_id")], "coord-sum")
    return ranked.select("station_id", (F.col("rank") - 1).alias("ord"))


def line_within(points: DataFrame, lines: DataFrame, buffer_km: float, cell: float = 0.05) -> DataFrame:
    """The nearest line (line_id, km) within a buffer of each point, null where there is none (ties: the smaller line_id).

    Segments: line_id, lat1, lon1, lat2, lon2. A point meets the segments that cross the cells its buffer touches.
    """
    dy, dx = nearest.box(F.lit(float(buffer_km)))
    seg = stored(lines.select("line_id", "lat1", "lon1", "lat2", "lon2"), "within-lines")
    best = nearest.nearest_in_boxes(points.select("station_id", "lat", "lon", dy.alias("dy"), dx.alias("dx")), seg, cell, "within")
    return points.select("station_id").join(best.where(F.col("km") <= buffer_km), "station_id", "left")


def kgrow(stations: DataFrame, seed: int, n: int, progress: list | None = None) -> DataFrame:
    """station_id, ord, dist: n stations grown from the seed (ord 0), each the nearest to those before it (dist; ties by id).

    Of the n stations nearest to a chosen one, one at least isn't chosen yet, so the chosen ones' lists of n neighbours are
    all that the order depends on. They are looked up for many candidates at once, and the order goes on until it needs a list that
    isn't there: few look-ups instead of n rounds, of n * n rows each at most. n is a small number, whatever the table's size.
    Without the seed the result is empty. progress: takes the number of stations of each look-up.
    """
    spark, lists = stations.sparkSession, {}
    chosen: list[tuple[int, int, float | None]] = []
    want = {seed} if not stations.where(F.col("station_id") == seed).isEmpty() else set()
    while want:
        if progress is not None:
            progress.append(len(want))
        for r in knn_ref(stations.where(F.col("station_id").isin(sorted(want))), stations, n, exclude_same=True).collect():  # n rows each
            lists.setdefault(r["station_id"], []).append((r["dist"], r["nb_id"]))
        for i in want:
            lists.setdefault(i, [])
        chosen, taken, heap, want = [(seed, 0, None)], {seed}, list(lists[seed]), set()
        heapq.heapify(heap)
        while len(chosen) < n and heap:
            dist, i = heapq.heappop(heap)
            if i in taken:
                continue
            taken.add(i)
            chosen.append((i, len(chosen), dist))
            if len(chosen) == n:
                break
            if i not in lists:  # and those that may well come next
                want = {i} | {x for _, x in heapq.nsmallest(n, heap) if x not in lists and x not in taken}
                break
            for entry in lists[i]:
                heapq.heappush(heap, entry)
    return spark.createDataFrame(chosen[:n], "station_id long, ord int, dist double")
