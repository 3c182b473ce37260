"""Paths over river graphs and grids, snapping, nearest lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import ecef, euclid, point_segment_km
from . import nearest
from .joins import knn_ref
from .raster import line_cells
from .supersteps import grow, stored


def _trees(edges: DataFrame, roots: DataFrame, most: int, name: str) -> DataFrame:
    """root, node, parent, hops: breadth first from all roots at once; of parents equally near, the smallest."""
    e = stored(edges.select("src", "dst").distinct(), f"{name}-edges")
    seed = roots.select("root", F.col("root").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hops"))

    def step(front: DataFrame, i: int) -> DataFrame:
        return front.join(e, front.node == e.src).groupBy("root", F.col("dst").alias("node")).agg(F.min("src").alias("parent")).withColumn("hops", F.lit(i))

    return grow(seed, step, ["root", "node"], name, most)


def reachability(edges: DataFrame, pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """a, b, there, back: hops from a to b and from b to a, null where `most` hops don't reach."""
    roots = pairs.select(F.col("a").alias("root")).union(pairs.select("b")).distinct()
    t = stored(_trees(edges, roots, most, "reach").select("root", "node", "hops"), "reach-hops")
    there = t.select(F.col("root").alias("a"), F.col("node").alias("b"), F.col("hops").alias("there"))
    back = t.select(F.col("root").alias("b"), F.col("node").alias("a"), F.col("hops").alias("back"))
    return pairs.select("a", "b").distinct().join(there, ["a", "b"], "left").join(back, ["a", "b"], "left")


def shortest_hop_paths(edges: DataFrame, pairs: DataFrame, most: int = 10_000) -> DataFrame:
    """a, b, dir, seq, node: a path of fewest hops from a (seq 0) to b, dir 1; where there is none, from b to a, dir -1.

    Pairs without either, within `most` hops, have no rows. All pairs are traced at once, one join a hop.
    """
    want = pairs.select("a", "b").distinct()
    roots = want.select(F.col("a").alias("root")).union(want.select("b")).distinct()
    tree = stored(_trees(edges, roots, most, "paths"), "paths-tree")
    ends = tree.select("root", "node", "hops")
    there = want.join(ends, (want.a == ends.root) & (want.b == ends.node)).select("a", "b", F.lit(1).alias("dir"), "root", "node", F.col("hops").alias("seq"))
    rest = want.join(there, ["a", "b"], "left_anti")
    back = rest.join(ends, (rest.b == ends.root) & (rest.a == ends.node)).select("a", "b", F.lit(-1).alias("dir"), "root", "node", F.col("hops").alias("seq"))
    up = tree.select("root", "node", "parent").where("parent is not null")
    seed = there.union(back)
    trace = grow(seed, lambda f, i: f.join(up, ["root", "node"]).select("a", "b", "dir", "root", F.col("parent").alias("node"), (F.col("seq") - 1).alias("seq")), ["a", "b", "seq"], "paths-trace")
    return trace.select("a", "b", "dir", "seq", "node")


def simplify_graph(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """station_id, src, dst, flag: each neighbour by way of the places where its path meets those of later neighbours.

    paths: station_id, nb_id, seq, node, from the neighbour to the station. For each later neighbour the first node of the
    path that the other's path holds, its last node aside, is kept; the chain neighbour, places in order, station has
    flag 1. A pair (station_id, nb_id) without a path gets one edge with flag -1.
    """
    own = Window.partitionBy("station_id", "nb_id")
    p = paths.withColumn("last", F.col("seq") == F.max("seq").over(own))
    other = p.where("not last").select("station_id", F.col("nb_id").alias("nb_b"), "node").distinct()
    meet = p.join(other, ["station_id", "node"]).where("nb_id < nb_b").groupBy("station_id", "nb_id", "nb_b").agg(F.min(F.struct("seq", "node")).alias("m"))
    places = meet.select("station_id", "nb_id", "m.seq", "m.node").union(p.where("seq = 0 or last").select("station_id", "nb_id", "seq", "node")).distinct()
    chain = places.withColumn("dst", F.lead("node").over(own.orderBy("seq"))).where("dst is not null and dst <> node")
    apart = pairs.join(paths, ["station_id", "nb_id"], "left_anti").select("station_id", F.col("nb_id").alias("src"), F.col("station_id").alias("dst"), F.lit(-1).alias("flag"))
    return chain.select("station_id", F.col("node").alias("src"), "dst", F.lit(1).alias("flag")).union(apart).distinct()


def path_cells(nodes: DataFrame) -> DataFrame:
    """path_id, part, seq, row, col: the cells between consecutive nodes (path_id, seq, row, col), a part for each pair.

    A whole path is its parts in order; a part begins with the cell the former ends with.
    """
    own = Window.partitionBy("path_id").orderBy("seq")
    n = nodes.select("path_id", F.row_number().over(own).alias("part"), F.col("row").alias("r0"), F.col("col").alias("c0"), F.lead("row").over(own).alias("r1"), F.lead("col").over(own).alias("c1"))
    lines = n.where("r1 is not null").select(F.struct("path_id", "part").alias("id"), "r0", "c0", "r1", "c1")
    return line_cells(lines).select("id.path_id", "id.part", "seq", "row", "col")


def snap_to_graph(points: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """station_id, src, dst, km, node: the nearest edge at one of the k nearest nodes, and its planar nearer end (ties: the smaller ids, the source).

    points and nodes: station_id, lat, lon; edges: src, dst. Points whose nodes have no edge get no row.
    """
    near = knn_ref(points, nodes, k).select("station_id", F.col("nb_id").alias("at"))
    both = edges.select("src", "dst").distinct().withColumn("at", F.explode(F.array("src", "dst")))
    at = lambda i: nodes.select(F.col("station_id").alias(i), F.col("lat").alias(f"{i}_lat"), F.col("lon").alias(f"{i}_lon"))
    pairs = near.join(both, "at").select("station_id", "src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").join(points.select("station_id", "lat", "lon"), "station_id")
    km = point_segment_km(ecef(F.col("lat"), F.col("lon")), ecef(F.col("src_lat"), F.col("src_lon")), ecef(F.col("dst_lat"), F.col("dst_lon")))
    d = lambda i: euclid(F.col("lat"), F.col("lon"), F.col(f"{i}_lat"), F.col(f"{i}_lon"))
    one = F.struct(km.alias("km"), "src", "dst", F.when(d("src") <= d("dst"), F.col("src")).otherwise(F.col("dst")).alias("node"))
    return pairs.groupBy("station_id").agg(F.min(one).alias("e")).select("station_id", "e.src", "e.dst", "e.km", "e.node")


def nearest_line(points: DataFrame, lines: DataFrame, cell: float = 0.05) -> DataFrame:
    """station_id, line_id, km of the nearest line (ties: the smaller id), however far; null where there are no lines.

    lines: line_id, lat1, lon1, lat2, lon2. A near vertex bounds the distance; what crosses the box of that distance can be nearer.
    So a point far from a long coast meets the stretch of it that comes into its box, and one among many long lines
    those that cross its cell. Not across 180 degrees.
    """
    seg = stored(lines.select("line_id", "lat1", "lon1", "lat2", "lon2"), "nearest-lines")
    dy, dx = nearest.box(F.col("bound"))
    boxes = nearest.bounded(points, seg).select("station_id", "lat", "lon", dy.alias("dy"), dx.alias("dx"))
    return points.select("station_id").join(nearest.nearest_in_boxes(boxes, seg, cell, "nearest"), "station_id", "left")


def dist_to_lines(points: DataFrame, lines: DataFrame) -> DataFrame:
    """Distance to the nearest line in metres, kilometres and hundreds of kilometres."""
    n = nearest_line(points, lines)
    return n.select("station_id", (F.col("km") * 1000).alias("m"), "km", (F.col("km") / 100).alias("km100"))


def expand_region(seed: DataFrame, allowed: DataFrame, iters: int, square: bool = False) -> DataFrame:
    """Cells (row, col) that `iters` dilations of the seed, by a cross or a square, reach inside the allowed cells."""
    off = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0) and (square or not a or not b)]
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in off]))
    ok = stored(allowed.select("row", "col").distinct(), "region-allowed")

    def step(front: DataFrame, i: int) -> DataFrame:
        return front.withColumn("o", o).select((F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col")).distinct().join(ok, ["row", "col"], "left_semi")

    return grow(seed.select("row", "col").join(ok, ["row", "col"], "left_semi").distinct(), step, ["row", "col"], "region", iters)
