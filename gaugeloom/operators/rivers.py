"""Paths along a river network whose edges have a direction and a width at both ends, and its simplified graphs.

edges: u, v (from u downstream to v), w1, w2 (width at u, at v), at most one edge for each (u, v); nodes: node, x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import snap_to_graph
from .supersteps import running_in_blocks, stored

#: Rows of a path that are numbered in one task.
BLOCK = 4096


def meeting_paths(links: DataFrame, pairs: DataFrame, progress: list | None = None) -> DataFrame:
    """a, b, seq, node: a path of fewest links between a (seq 0) and b for each pair; pairs without one have no rows.

    links: src, dst, without direction. Both ends of a pair spread in turn, one level each a round, until they meet:
    levels hold half a path's length, and only pairs still open have a frontier. A level is kept from two
    before it, which is all that a graph without directions needs. Of nodes where both meet the
    smallest counts, of parents as well. Backwards, a round reads one level. progress: takes the number of open pairs.
    """
    both = stored(links.select("src", "dst").union(links.select("dst", "src")).where("src <> dst").distinct(), "meet-links")
    want = stored(pairs.select("a", "b").distinct(), "meet-pairs")
    start = lambda c: want.where("a <> b").select("a", "b", F.col(c).alias("node"), F.lit(None).cast("long").alias("parent"))
    front = {c: stored(start(c), "meet-front") for c in "ab"}
    levels = {c: [front[c]] for c in "ab"}
    found = [want.where("a = b").select("a", "b", F.col("a").alias("node"), F.lit(0).alias("from_a"), F.lit(0).alias("from_b"))]
    while not front["a"].isEmpty():
        if progress is not None:
            progress.append(front["a"].select("a", "b").distinct().count())
        for c, other in (("a", "b"), ("b", "a")):
            new = front[c].join(both, front[c].node == both.src).groupBy("a", "b", F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
            for old in levels[c][-2:]:
                new = new.join(old.select("a", "b", "node"), ["a", "b", "node"], "left_anti")
            front[c] = stored(new, "meet-front")
            levels[c].append(front[c])
            hit = front[c].join(front[other].select("a", "b", "node"), ["a", "b", "node"]).groupBy("a", "b").agg(F.min("node").alias("node"))
            far = {x: len(levels[x]) - 1 for x in "ab"}
            hit = stored(hit.select("a", "b", "node", F.lit(far["a"]).alias("from_a"), F.lit(far["b"]).alias("from_b")), "meet-found")
            found.append(hit)
            front = {x: front[x].join(hit.select("a", "b"), ["a", "b"], "left_anti") for x in "ab"}
        # a pair one of whose ends has no further node is closed
        front = {x: stored(front[x].join(front[y].select("a", "b").distinct(), ["a", "b"], "left_semi"), "meet-open") for x, y in ("ab", "ba")}
    met = found[0]
    for f in found[1:]:
        met = met.unionByName(f)
    met = stored(met, "meet-all")
    out = met.select("a", "b", F.col("from_a").alias("seq"), "node")
    for c in "ab":
        at = None
        for i in range(len(levels[c]) - 1, 0, -1):
            here = met.where(F.col(f"from_{c}") == i).select("a", "b", "node", (F.col("from_a") + F.col("from_b")).alias("hops"))
            here = here if at is None else here.unionByName(at)
            up = here.join(levels[c][i], ["a", "b", "node"]).select("a", "b", F.col("parent").alias("node"), "hops")
            at = stored(up, "meet-trace")
            seq = F.lit(i - 1) if c == "a" else F.col("hops") - (i - 1)
            out = out.unionByName(at.select("a", "b", seq.alias("seq"), "node"))
    return out


def _distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def directed_steps(paths: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq (from 1), src, dst, forward, length, width: steps of paths (keys, seq from 0, node).

    forward: the network has the edge in the path's direction; else it is walked against the edge. width is that of
    the node which the step leaves.
    """
    c = F.col
    a = paths.select(*keys, (c("seq") + 1).alias("seq"), c("node").alias("src"))
    step = a.join(paths.select(*keys, "seq", c("node").alias("dst")), [*keys, "seq"])
    down = edges.select(c("u").alias("src"), c("v").alias("dst"), c("w1").alias("w_down"))
    up = edges.select(c("v").alias("src"), c("u").alias("dst"), c("w2").alias("w_up"))
    at = lambda i: nodes.select(c("node").alias(i), c("x").alias(f"{i}_x"), c("y").alias(f"{i}_y"))
    known = step.join(down, ["src", "dst"], "left").join(up, ["src", "dst"], "left").join(at("src"), "src").join(at("dst"), "dst")
    length = _distance(c("src_x"), c("src_y"), c("dst_x"), c("dst_y"))
    return known.select(*keys, "seq", "src", "dst", c("w_down").isNotNull().alias("forward"), length.alias("length"), F.coalesce("w_down", "w_up").alias("width"))


def bfs_with_direction(edges: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, seq, src, dst, forward, length, width: the steps of a path of fewest edges from a to b, edges taken both ways.

    Pairs that don't hang together, and pairs of one node, have no steps.
    """
    paths = stored(meeting_paths(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), pairs), "bfs-paths")
    return directed_steps(paths, edges, nodes, ["a", "b"])


def station_paths(stations: DataFrame, neighbors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """station_id, nb_id, seq, node, src, dst: the path along the network from a station's node to that of each neighbour.

    stations: station_id, lat, lon; nodes: node, lat, lon; edges: u, v. A station's node is the nearer end of the nearest
    edge at its k nearest nodes. src and dst are the edge into a node in the network's own direction, null
    at seq 0. A neighbour that can't be reached, or is snapped to no node, has one row without seq and node.
    """
    c = F.col
    places = nodes.select(c("node").alias("station_id"), "lat", "lon")
    links = edges.select(c("u").alias("src"), c("v").alias("dst"))
    snapped = stored(snap_to_graph(stations, places, links, k).select("station_id", "node"), "station-nodes")
    own = neighbors.select("station_id", "nb_id").distinct().join(snapped.withColumnRenamed("node", "a"), "station_id", "left").join(snapped.select(c("station_id").alias("nb_id"), c("node").alias("b")), "nb_id", "left")
    own = stored(own, "station-pairs")
    paths = stored(meeting_paths(links, own.where("a is not null and b is not null")), "station-paths")
    before = paths.select("a", "b", (c("seq") + 1).alias("seq"), c("node").alias("prev"))
    down = links.select(c("src").alias("prev"), c("dst").alias("node"), F.lit(True).alias("down")).distinct()
    edge = paths.join(before, ["a", "b", "seq"], "left").join(down, ["prev", "node"], "left")
    edge = edge.select("a", "b", "seq", "node", F.when(c("down"), c("prev")).otherwise(F.when(c("prev").isNotNull(), c("node"))).alias("src"), F.when(c("down"), c("node")).otherwise(c("prev")).alias("dst"))
    return own.join(edge, ["a", "b"], "left").select("station_id", "nb_id", "seq", "node", "src", "dst")


def contract_chains(edges: DataFrame, nodes: DataFrame, keep: DataFrame, progress: list | None = None) -> DataFrame:
    """src, dst, steps, forward, back, mean, std, least, most: chains of nodes with two edges, each as one edge.

    A node stays if it is in keep (node) or hasn't exactly two edges. Each edge has two half-edges, and one whose head
    goes points to the next along; sums of lengths with and against the edges' directions, and of widths (at the
    nodes left) and their squares, least and largest merge while pointers double: a logarithm of the longest
    chain in rounds. Of a chain's two directions the one from the smaller node is given; rings without a node
    that stays are left out. progress: takes the number of half-edges not at their end.
    """
    c = F.col
    e = edges.select(F.monotonically_increasing_id().alias("edge"), "u", "v", "w1", "w2")
    e = stored(e, "chain-edges")
    ends = e.select(c("u").alias("node"), "edge").unionAll(e.select("v", "edge"))
    through = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("edge").alias("m")).where("n = 2 and m = 2").join(keep.select("node"), "node", "left_anti").select("node")
    through = stored(through, "chain-through")
    half = e.select("edge", F.explode(F.array(F.struct(F.lit(True).alias("down"), c("u").alias("src"), c("v").alias("dst"), c("w1").alias("w")), F.struct(F.lit(False).alias("down"), c("v").alias("src"), c("u").alias("dst"), c("w2").alias("w")))).alias("h"))
    half = half.select((c("edge") * 2 + F.when(c("h.down"), 0).otherwise(1)).alias("half"), "edge", "h.*")
    at = lambda i: nodes.select(c("node").alias(i), c("x").alias(f"{i}_x"), c("y").alias(f"{i}_y"))
    half = half.join(at("src"), "src").join(at("dst"), "dst").withColumn("length", _distance(c("src_x"), c("src_y"), c("dst_x"), c("dst_y")))
    half = stored(half.select("half", "edge", "down", "src", "dst", "w", "length"), "chain-halves")
    further = half.select(c("src").alias("dst"), c("half").alias("next"), c("edge").alias("other")).join(through.withColumnRenamed("node", "dst"), "dst", "left_semi")
    inner = half.join(further, "dst").where("edge <> other").select("half", "next")
    first = half.join(inner, "half", "left").select(
        "half", "src", "dst", c("next").alias("to"), F.lit(1).cast("long").alias("steps"), F.when(c("down"), c("length")).otherwise(0.0).alias("forward"), F.when(c("down"), 0.0).otherwise(c("length")).alias("back"),
        c("w").alias("s1"), (c("w") * c("w")).alias("s2"), c("w").alias("least"), c("w").alias("most"),
    )
    chain, open_before = stored(first, "chain"), None
    while True:
        left = chain.where("to is not null").count()
        if left == 0 or left == open_before:  # each round ends some, until rings alone are left
            break
        open_before = left
        if progress is not None:
            progress.append(left)
        b = chain.select(*[c(x).alias(f"{x}_2") for x in chain.columns])
        plus = lambda x: (c(x) + F.coalesce(f"{x}_2", F.lit(0))).alias(x)
        chain = stored(chain.join(b, c("to") == c("half_2"), "left").select(
            "half", "src", F.coalesce("dst_2", "dst").alias("dst"), c("to_2").alias("to"), *map(plus, ("steps", "forward", "back", "s1", "s2")), F.least("least", "least_2").alias("least"), F.greatest("most", "most_2").alias("most"),
        ), "chain")
    whole = chain.where("to is null").join(through.withColumnRenamed("node", "src"), "src", "left_anti")
    # Both directions of a chain are here; a loop from a node to itself has the same sums either way but for the sides.
    one = whole.where("src < dst")
    loops = whole.where("src = dst").groupBy("src", "dst", "steps", F.round(c("forward") + c("back"), 9).alias("size"), F.least("forward", "back").alias("f")).agg(F.min_by(F.struct("steps", "forward", "back", "s1", "s2", "least", "most"), "half").alias("l")).select("src", "dst", "l.*")
    one = one.drop("half", "to").unionByName(loops)
    mean = c("s1") / c("steps")
    return one.select("src", "dst", "steps", "forward", "back", mean.alias("mean"), F.sqrt(F.greatest(c("s2") / c("steps") - mean * mean, F.lit(0.0))).alias("std"), "least", "most")


def station_node(station_id: Column) -> Column:
    """The node number of a station itself: negative, so that it meets none of the network."""
    return -station_id - 1


def simplify_true_direction(paths: DataFrame, neighbors: DataFrame, stations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """station_id, src, dst, mean, std, least, most, median, forward, back: each station's graph of important nodes.

    paths: station_id, nb_id, seq, node, as station_paths gives them; neighbors: station_id, nb_id, rank; stations:
    station_id, x, y; nodes and edges of the network. A path runs from the neighbour to the station, whichever way it
    is given, with both as its ends (`station_node`); the steps that join them to the network have the
    widths of the edge beside them. For two neighbours, the first node of the nearer one's path that the
    other's holds too, the station aside, is important, and so are all neighbours and the station.
    A row says how a path goes from one important node to the next: statistics of widths at the nodes it leaves, and lengths
    with and against the edges' directions. Statistics of a hop need its steps; all else is by blocks of a path.
    """
    c, key = F.col, ["station_id", "nb_id"]
    given = stored(paths.where("node is not null").select(*key, "seq", "node"), "true-paths")
    first = given.where("seq = 0").join(nodes, "node").select(*key, c("x").alias("fx"), c("y").alias("fy"))
    place = lambda i, p: stations.select(c("station_id").alias(i), c("x").alias(f"{p}x"), c("y").alias(f"{p}y"))
    ends = given.groupBy(*key).agg(F.max("seq").alias("last")).join(first, key).join(place("station_id", "k"), "station_id").join(place("nb_id", "n"), "nb_id")
    to_station = F.pow(c("fx") - c("kx"), 2) + F.pow(c("fy") - c("ky"), 2)
    to_neighbor = F.pow(c("fx") - c("nx"), 2) + F.pow(c("fy") - c("ny"), 2)
    # turned: the path starts at the station, so that its edges' directions are seen from there
    ends = stored(ends.select(*key, "last", (to_station < to_neighbor).alias("turned")), "true-ends")
    inner = given.join(ends, key).select(*key, (F.when(c("turned"), c("last") - c("seq")).otherwise(c("seq")) + 1).alias("seq"), "node")
    tips = ends.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("seq"), station_node(c("nb_id")).alias("node")), F.struct((c("last") + 2).alias("seq"), station_node(c("station_id")).alias("node")))).alias("t")).select(*key, "t.*")
    walk = stored(inner.unionByName(tips), "true-walk")
    # Where two neighbours' paths meet first, the nearer one's first.
    rank = neighbors.select(*key, "rank")
    ranked = walk.where("node >= 0").join(rank, key)
    other = ranked.select("station_id", c("nb_id").alias("nb_b"), c("rank").alias("rank_b"), "node").distinct()
    meet = ranked.join(other, ["station_id", "node"]).where("rank < rank_b").groupBy(*key, "nb_b").agg(F.min_by("node", "seq").alias("node"))
    important = meet.select("station_id", "node").unionByName(walk.where("node < 0").select("station_id", "node")).distinct().withColumn("mark", F.lit(1))
    marked = walk.join(important, ["station_id", "node"], "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    marked = marked.select(F.struct(*key).alias("path"), "seq", "node", "mark", F.floor(c("seq") / BLOCK).alias("block"))
    hops = stored(running_in_blocks(marked, "path", "block", "seq", {"mark": "hop"}, "true-marks").select("path.*", "seq", "node", "mark", "hop"), "true-hops")
    # Steps, with the tips joined to the network by the edge beside them.
    inside = directed_steps(inner, edges, nodes, key)  # inner starts at seq 1, so its steps at 2
    beside = inside.join(ends, key).where((c("seq") == 2) | (c("seq") == c("last") + 1))
    w = edges.select("u", "v", "w1", "w2")
    beside = beside.withColumns({"u": F.when(c("forward"), c("src")).otherwise(c("dst")), "v": F.when(c("forward"), c("dst")).otherwise(c("src"))}).join(w, ["u", "v"])
    spots = nodes.select("node", "x", "y").unionByName(stations.select(station_node(c("station_id")).alias("node"), "x", "y"))
    tip = walk.select(*key, (c("seq") + 1).alias("seq"), c("node").alias("src")).join(walk.select(*key, "seq", c("node").alias("dst")), [*key, "seq"]).where("src < 0 or dst < 0")
    near = beside.select(*key, F.explode(F.array(F.when(c("seq") == 2, F.lit(1)), F.when(c("seq") == c("last") + 1, c("last") + 2))).alias("seq"), "w1", "w2").where("seq is not null")
    at = lambda i: spots.select(c("node").alias(i), c("x").alias(f"{i}_x"), c("y").alias(f"{i}_y"))
    tip = tip.join(near, [*key, "seq"], "left").join(ends.select(*key, "turned"), key).join(at("src"), "src").join(at("dst"), "dst")
    length = _distance(c("src_x"), c("src_y"), c("dst_x"), c("dst_y"))
    # The joining edges run as the path was given: with it, or against it where it was turned.
    tip = tip.select(*key, "seq", (~c("turned")).alias("forward"), length.alias("length"), F.when(c("turned"), c("w2")).otherwise(c("w1")).alias("width"))
    steps = inside.select(*key, "seq", "forward", "length", "width").unionByName(tip)
    start = hops.select(*key, (c("seq") + 1).alias("seq"), "hop")
    sums = steps.join(start, [*key, "seq"]).groupBy(*key, "hop").agg(
        F.avg("width").alias("mean"), F.stddev_pop("width").alias("std"), F.min("width").alias("least"), F.max("width").alias("most"), F.median("width").alias("median"),
        F.sum(F.when(c("forward"), c("length")).otherwise(0.0)).alias("forward"), F.sum(F.when(c("forward"), 0.0).otherwise(c("length"))).alias("back"),
    )
    stop = hops.where("mark = 1").select(*key, "hop", "node")
    out = sums.join(stop.withColumnRenamed("node", "src"), [*key, "hop"]).join(stop.select(*key, (c("hop") - 1).alias("hop"), c("node").alias("dst")), [*key, "hop"])
    return out.select("station_id", "src", "dst", "mean", "std", "least", "most", "median", "forward", "back").distinct()
