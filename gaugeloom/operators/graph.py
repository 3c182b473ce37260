"""River graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import haversine_km
from .supersteps import grow, stored


def lines_to_edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices of a line (line_id, seq, lat, lon) as directed edges with their length."""
    w = Window.partitionBy("line_id").orderBy("seq")
    v = vertices.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    return v.select("line_id", "seq", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km"))


def path_length_km(vertices: DataFrame) -> DataFrame:
    return lines_to_edges(vertices).groupBy("line_id").agg(F.sum("km").alias("km"))


def hops_to_target(edges: DataFrame, target: int) -> DataFrame:
    """Fewest directed edges to the target, -1 for nodes that don't reach it."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    back = stored(edges.select("src", "dst").distinct(), "hops-edges")
    seed = nodes.where(F.col("node") == target).withColumn("hops", F.lit(0))
    found = grow(seed, lambda f, i: back.join(f.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), F.lit(i).alias("hops")), ["node"], "hops")
    return nodes.join(found, "node", "left").select("node", F.coalesce("hops", F.lit(-1)).alias("hops"))


def on_path_edges(edges: DataFrame, hops: DataFrame) -> DataFrame:
    a = hops.select(F.col("node").alias("src"), F.col("hops").alias("hs"))
    b = hops.select(F.col("node").alias("dst"), F.col("hops").alias("hd"))
    return edges.join(a, "src").join(b, "dst").where("hd >= 0 and hs = hd + 1").select("src", "dst")


def orient_edges(edges: DataFrame) -> DataFrame:
    """dir 1 keeps an edge, -1 turns it, another gives both."""
    kept = edges.where("dir <> -1").select("src", "dst")
    turned = edges.where("dir <> 1").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return kept.union(turned).distinct()


def components(edges: DataFrame, progress: list | None = None) -> DataFrame:
    """node and its component's smallest node, whatever the edges' directions.

    Each round hooks every root to the smallest root beside it, flattens what hangs together by pointer
    doubling, and goes on with the roots alone and the edges between them, of which each round leaves a
    fraction: so rounds are a logarithm of the nodes, not of the longest path. progress: takes the
    number of edges of each round.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    nodes = both.select(F.col("src").alias("node")).distinct()
    left, steps = stored(both.where("src <> dst"), "graph-edges"), []
    while not left.isEmpty():
        if progress is not None:
            progress.append(left.count())
        up = left.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root"))
        roots = _flat(stored(up, "graph-hooks"))
        steps.append(roots)
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst"))
        left = stored(left.join(a, "src").join(b, "dst").where("src_root <> dst_root").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).distinct(), "graph-edges")
    labels = None
    for roots in reversed(steps):  # from the few last roots back to all nodes
        if labels is not None:
            roots = roots.join(labels.select(F.col("node").alias("root"), "label"), "root", "left").select("node", F.coalesce("label", "root").alias("label"))
            labels = stored(roots, "graph-labels")
        else:
            labels = roots.withColumnRenamed("root", "label")
    if labels is None:
        return nodes.withColumn("label", F.col("node"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _flat(up: DataFrame) -> DataFrame:
    """A forest of (node, root) with each node's last root: pointer doubling, four times as far each round."""
    while True:
        twice = _jumped(up, up)
        far = stored(_jumped(twice, twice), "graph-roots")
        if far.where("moved").isEmpty():
            return far.select("node", "root")
        up = far.select("node", "root")


def _jumped(up: DataFrame, further: DataFrame) -> DataFrame:
    ahead = further.select(F.col("node").alias("at"), F.col("root").alias("far"))
    return up.join(ahead, up.root == ahead.at).select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved"))


def trim_component(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges of the components that hold one of the nodes to keep."""
    c = stored(components(edges), "graph-components")
    good = c.join(c.join(keep, "node", "left_semi").select("label").distinct(), "label", "left_semi")
    return edges.join(good.select(F.col("node").alias("src")), "src", "left_semi")


def edge_softmax(edges: DataFrame) -> DataFrame:
    """Softmax of `score` over the edges into the same node."""
    w = Window.partitionBy("dst")
    e = edges.withColumn("top", F.max("score").over(w)).withColumn("x", F.exp(F.col("score") - F.col("top")))
    return e.withColumn("alpha", F.col("x") / F.sum("x").over(w)).select("src", "dst", "alpha")


def level_propagate(nodes: DataFrame, edges: DataFrame, hops: DataFrame) -> DataFrame:
    """From the farthest hop inwards, each node adds alpha times the values of those a hop farther out (node, pos, value)."""
    path = stored(on_path_edges(edges, hops).join(edges.select("src", "dst", "alpha"), ["src", "dst"]).join(hops.select(F.col("node").alias("src"), "hops"), "src"), "level-edges")
    state = stored(nodes, "level")
    for h in range(path.agg(F.max("hops")).first()[0] or 0, 0, -1):
        add = path.where(F.col("hops") == h).join(state.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "pos").agg(F.sum(F.col("alpha") * F.col("value")).alias("more"))
        state = stored(state.join(add, ["node", "pos"], "left").select("node", "pos", (F.col("value") + F.coalesce("more", F.lit(0.0))).alias("value")), "level")
    return state


def first_common_node(paths: DataFrame) -> DataFrame:
    """For each two neighbours of a target (paths: station_id, nb_id, seq, node), the first node of the one's path that the other's holds."""
    a = paths.withColumnsRenamed({"nb_id": "nb_a", "seq": "seq_a"})
    b = paths.select("station_id", F.col("nb_id").alias("nb_b"), "node").distinct()
    both = a.join(b, ["station_id", "node"]).where("nb_a < nb_b")
    return both.groupBy("station_id", "nb_a", "nb_b").agg(F.min(F.struct("seq_a", "node")).alias("m")).select("station_id", "nb_a", "nb_b", "m.node")
