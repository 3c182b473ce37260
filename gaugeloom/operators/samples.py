"""From cleaned series to the tables that models read: alignment, features, splits, samples."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import signed_displacement_km
from .joins import split_from_labels


def normalize_time(df: DataFrame, col: str, zone: str = "UTC") -> DataFrame:
    """Times without a zone, taken as local to `zone`, as UTC without a zone."""
    return df.withColumn(col, F.convert_timezone(F.lit(zone), F.lit("UTC"), F.col(col)))


def to_float32(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in cols})


def coverage_check(nodes: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """How many nodes lie outside a raster's bounds (minlon, minlat, maxlon, maxlat), and how many there are."""
    inside = F.col("lon").between(bounds[0], bounds[2]) & F.col("lat").between(bounds[1], bounds[3])
    return nodes.agg(F.count(F.when(~F.coalesce(inside, F.lit(False)), 1)).alias("outside"), F.count(F.lit(1)).alias("total"))


def align_series(water: DataFrame, rain: DataFrame) -> DataFrame:
    """station_id, ts, value, rain where both have a value."""
    return water.where("value is not null").join(rain.where("rain is not null"), ["station_id", "ts"])


def flatten_segments(segments: DataFrame, weeks: DataFrame) -> DataFrame:
    """Values of the chosen weeks of each station one after another: station_id, pos, value. segments: station_id, week_idx, values."""
    chosen = segments.join(weeks, ["station_id", "week_idx"], "left_semi")
    before = Window.partitionBy("station_id").orderBy("week_idx").rowsBetween(Window.unboundedPreceding, -1)
    at = chosen.withColumn("before", F.coalesce(F.sum(F.size("values")).over(before), F.lit(0)))
    wide = at.select("station_id", "before", F.posexplode("values").alias("i", "value"))
    return wide.select("station_id", (F.col("before") + F.col("i")).cast("long").alias("pos"), "value")


def _draw(seed: str, *cols: str) -> Column:
    """A hash that is the same in each run and in other engines."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def sample_week(weeks: DataFrame, seed: str, least: int = 1) -> DataFrame:
    """One week of each station that has at least `least`, drawn by a hash."""
    own = Window.partitionBy("station_id")
    nth = F.row_number().over(own.orderBy(_draw(seed, "station_id", "week_idx")))
    return weeks.withColumns({"n": F.count(F.lit(1)).over(own), "nth": nth}).where((F.col("nth") == 1) & (F.col("n") >= least)).select("station_id", "week_idx")


def random_split(df: DataFrame, key: str, valid: float, test: float, seed: str) -> DataFrame:
    """df with role train, valid or test, by a hash of the key."""
    u = F.conv(F.substring(_draw(seed, key), 1, 8), 16, 10).cast("double") / 2**32
    return df.withColumn("role", F.when(u < test, "test").when(u < test + valid, "valid").otherwise("train"))


def split_by_cluster(stations: DataFrame, neighbors: DataFrame, clusters: int, train: int, seed: int) -> DataFrame:
    """Cluster the stations by place, take `train` clusters with their neighbours for training, the others for testing."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    placed = VectorAssembler(inputCols=["lat", "lon"], outputCol="place").transform(stations)
    told = KMeans(k=clusters, seed=seed, featuresCol="place", predictionCol="found").fit(placed).transform(placed)
    told = told.select("station_id", F.col("found").alias("cluster"))
    chosen = sorted(range(clusters), key=lambda c: hashlib.md5(f"{seed}:{c}".encode()).hexdigest())[:train]
    return split_from_labels(told, neighbors, chosen)


def neighbor_features(neighbors: DataFrame, stations: DataFrame) -> DataFrame:
    """Features of each (station_id, nb_id): distance, displacement, difference of elevation, direction, widths, coordinates."""
    a = stations.select("station_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("elevation").alias("z1"), F.col("width").alias("width1"))
    b = stations.select(F.col("station_id").alias("nb_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("elevation").alias("z2"), F.col("width").alias("width2"))
    moved = signed_displacement_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    out = neighbors.join(a, "station_id").join(b, "nb_id").withColumn("moved", moved)
    return out.select(
        "station_id", "nb_id", "dist", F.col("moved.north_km").alias("dx"), F.col("moved.east_km").alias("dy"), (F.col("z2") - F.col("z1")).alias("dz"),
        F.signum(F.col("z2") - F.col("z1")).cast("int").alias("dir"), "width1", "width2", "lat1", "lon1", "lat2", "lon2",
    )


def edge_attr_normalize(edges: DataFrame, graph: str, cols: list[str], absent: float = -10.0) -> DataFrame:
    """Each column over its largest magnitude in the graph, then as 1 / (v + 1e-8); rows whose first column is `absent` don't count and keep their values."""
    real = F.col(cols[0]) != absent
    own = Window.partitionBy(graph)
    scaled = {c: F.when(real, 1 / (F.col(c) / F.max(F.when(real, F.abs(c))).over(own) + 1e-8)).otherwise(F.col(c)) for c in cols}
    return edges.select(*[F.col(c) for c in edges.columns if c not in cols], *[v.alias(c) for c, v in scaled.items()])


def build_samples(neighbors: DataFrame, series: DataFrame) -> DataFrame:
    """A target's value beside those of its neighbours at the same place: station_id, pos, rank, target, value, dist."""
    target = series.withColumnRenamed("value", "target")
    near = neighbors.select("station_id", "nb_id", "rank", "dist").join(series.withColumnRenamed("station_id", "nb_id"), "nb_id")
    return near.join(target, ["station_id", "pos"]).select("station_id", "pos", "rank", "target", "value", "dist")


def node_table(nodes: DataFrame, features: DataFrame, series: DataFrame) -> DataFrame:
    """Features and series of each node (node, pos), zeros where a node has none; has_series tells which."""
    places = series.select("pos").distinct()
    told = series.withColumnRenamed("station_id", "node")
    out = nodes.join(features.withColumnRenamed("station_id", "node"), "node", "left").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(places.agg(F.max("pos")).first()[0] or 0))))
    out = out.join(told, ["node", "pos"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select("node", "pos", zero("value"), *[zero(c) for c in features.columns if c != "station_id"], F.col("value").isNotNull().alias("has_series"))


def kernel_knn(pairs: DataFrame, covariance: Column, k: int) -> DataFrame:
    """The k candidates of highest covariance of each target: station_id, nb_id, rank, cov."""
    order = Window.partitionBy("station_id").orderBy(F.col("cov").desc(), "nb_id")
    ranked = pairs.withColumn("cov", covariance).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("station_id", "nb_id", "rank", "cov")


def tile_allow(paths: DataFrame, allowed: DataFrame, most: int = 3) -> DataFrame:
    """Pairs whose path (station_id, nb_id, tile) stays in allowed tiles, and in `most` of them."""
    ok = paths.join(allowed.select("tile").distinct().withColumn("ok", F.lit(True)), "tile", "left")
    told = ok.groupBy("station_id", "nb_id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all"), F.countDistinct("tile").alias("n"))
    return told.where(F.col("all") & (F.col("n") <= most)).select("station_id", "nb_id")


def group_by_tile_set(paths: DataFrame) -> DataFrame:
    """How many pairs have paths through each set of tiles."""
    sets = paths.groupBy("station_id", "nb_id").agg(F.array_join(F.array_sort(F.collect_set("tile")), ",").alias("tiles"))
    return sets.groupBy("tiles").agg(F.count(F.lit(1)).alias("n"))


def first_elevation(neighbors: DataFrame, stats: DataFrame) -> DataFrame:
    """A station's elevation from its first edge (by rank) that has one. stats: station_id, nb_id, elevation."""
    known = neighbors.join(stats.where("elevation is not null"), ["station_id", "nb_id"])
    return known.groupBy("station_id").agg(F.min_by("elevation", F.struct("rank", "nb_id")).alias("elevation"))


def distinct_widths(lines: DataFrame) -> DataFrame:
    return lines.where("width is not null").select("width").distinct()


def width_stats(path: DataFrame) -> DataFrame:
    """Statistics of the widths along each path (station_id, nb_id, seq, width, km, dir), and the length with and against the flow."""
    return path.groupBy("station_id", "nb_id").agg(
        F.avg("width").alias("mean"), F.stddev_pop("width").alias("std"), F.min("width").alias("min"), F.max("width").alias("max"), F.median("width").alias("median"),
        F.sum(F.when(F.col("dir") >= 0, F.col("km")).otherwise(0.0)).alias("forward_km"), F.sum(F.when(F.col("dir") < 0, F.col("km")).otherwise(0.0)).alias("backward_km"),
    )


def dry_neighbor_index(neighbors: DataFrame, rain: DataFrame, least: float = 0.01) -> DataFrame:
    """How many leading neighbours come before the first whose rain sums to less than `least`."""
    total = rain.groupBy(F.col("station_id").alias("nb_id")).agg(F.sum("value").alias("total"))
    first = neighbors.join(total, "nb_id").groupBy("station_id").agg(F.min(F.when(F.col("total") < least, F.col("rank"))).alias("dry"), F.count(F.lit(1)).alias("n"))
    return first.select("station_id", F.coalesce(F.col("dry") - 1, F.col("n")).cast("long").alias("wet"))


def group_consensus(series: DataFrame, neighbors: DataFrame) -> DataFrame:
    """Mean absolute correlation of each neighbour with all others of its target's group, scaled so that the group spans 0 to 1."""
    a = neighbors.select("station_id", F.col("nb_id").alias("a"))
    both = a.join(neighbors.select("station_id", F.col("nb_id").alias("b")), "station_id").where("a <> b")
    pairs = both.select("a", "b").where("a < b").distinct()
    c = pairs.join(series.select(F.col("station_id").alias("a"), "pos", F.col("value").alias("x")), "a").join(series.select(F.col("station_id").alias("b"), "pos", F.col("value").alias("y")), ["b", "pos"])
    c = c.groupBy("a", "b").agg(F.abs(F.corr("x", "y")).alias("c"))
    c = c.union(c.select(F.col("b"), F.col("a"), "c"))
    own = both.join(c, ["a", "b"]).groupBy("station_id", F.col("a").alias("nb_id")).agg(F.avg("c").alias("mean"))
    group = Window.partitionBy("station_id")
    low, high = F.min("mean").over(group), F.max("mean").over(group)
    return own.select("station_id", "nb_id", F.coalesce(F.try_divide(F.col("mean") - low, high - low), F.lit(0.0)).alias("consensus"))


def centered_cosine(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Cosine of the two columns after taking off their means."""
    return pairs.groupBy(*by).agg(F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias("rho"))


def station_gate(pred: DataFrame, steepness: float = 10.0, least: float = 0.5) -> DataFrame:
    """pred (station_id, pos, out, raw): out and raw mixed by g = 1 / (1 + exp(-steepness * (rho - least))), rho being their centred cosine."""
    rho = centered_cosine(pred, ["station_id"], "out", "raw")
    g = 1 / (1 + F.exp(-steepness * (F.col("rho") - least)))
    return pred.join(rho.withColumn("gate", g), "station_id").select("station_id", "pos", (F.col("gate") * F.col("out") + (1 - F.col("gate")) * F.col("raw")).alias("value"))
