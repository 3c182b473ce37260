"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (the source's target over its
size). Expected copies are summed along the source's documents in order of size, one random offset
is added, and a document is emitted once for each integer that its stretch of the sum crosses.
Ordered by size, neighbours are alike, so the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Sources by code point, null last, weigh so much in turn; a source gives at most CAP times its words.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, stopped at cap times the size.

    The excess is shared again by weight until no source is above its cap. Sorted by cap over weight,
    the capped sources come first, so one running sum finds them. One row a source meets in a window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_room = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    rest = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    out = sizes.withColumn("weight", turn.cast("long")).withColumn("room", F.col("source_size") * cap)
    out = out.withColumns({"total": F.sum("source_size").over(everything), "left_weight": F.sum("weight").over(rest), "room_left": F.sum("room").over(rest), "room_all": F.sum("room").over(everything)})
    # what is left for this source and those with more room, if all before it are capped
    out = out.withColumn("left", F.col("total") - (F.col("room_all") - F.col("room_left")))
    capped = F.col("room") * F.col("left_weight") <= F.col("left") * F.col("weight")
    out = out.withColumn("capped", capped)
    free = ~F.col("capped")
    out = out.withColumns({"pot": F.max(F.when(free, F.col("left"))).over(everything), "free_weight": F.sum(F.when(free, F.col("weight")).otherwise(0)).over(everything)})
    share = F.when(F.col("capped"), F.col("room").cast("double")).otherwise((F.col("pot") * F.col("weight")).cast("double") / F.col("free_weight"))
    return out.select("source", "source_size", share.alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """A source's offset in [0, 1), the same in each run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source.cast("string"), F.lit("\x00null"))))
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65536


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    size is the number of words; a null or empty text has none and is never taken. A null source is
    a source of its own, the last. Repeated rows are rows of their own; ties in size fall by a hash
    of doc_id. A source of no words has target 0. An empty table gives an empty plan.
    """
    size = F.regexp_count(C.text_of(text_col), F.lit(C.WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(C.text_of(text_col)).alias("text_hash"))
    rows = rows.withColumn("tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = ["source", "size", "tie", "doc_id", "text_hash"]
    placed = C.ranked(rows.withColumn("one", F.lit(1).cast("long")), order, "one", "mix-order")
    placed = placed.withColumn("rank", F.col("before"))
    # Sums by source and part first: no source's rows meet in one task.
    stats = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("rank").alias("first"))
    stats = C.stored(stats, "mix-sources")
    targets = source_targets(stats.select("source", "source_size")).select(F.col("source").alias("s"), "target")
    stats = C.stored(stats.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"), "mix-targets")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    stats = C.stored(stats.withColumn("key", F.coalesce(F.concat(F.lit("="), "s"), F.lit("null"))).drop("s"), "mix-keys")
    joined = C.join_groups(placed.withColumn("key", key), stats, "key")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    nth = (F.col("rank") - F.col("first")).cast("double")
    start = offset_of(F.col("source"), seed)
    copies = F.floor((nth + 1) * F.col("expected") + start) - F.floor(nth * F.col("expected") + start)
    out = joined.withColumn("expected", expected).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    return out.select("doc_id", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents as the plan takes them, with all their columns: each row as often as it has copies.

    Copies of rows that repeat doc_id and text all come from one of these rows. Texts are shuffled
    once, to meet their copies; nothing is sorted or ranked with them but by that join.
    """
    plan = mix_plan(docs, id_col, text_col, **options)
    plan = C.stored(plan.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0"), "mix-copies")
    on = F.col("__own_id").eqNullSafe(F.col("doc_id")) & (F.col("__own_hash") == F.col("text_hash"))

    def own(rows: DataFrame) -> DataFrame:
        return rows.select(F.struct("*").alias("__row"), F.col(id_col).alias("__own_id"), F.xxhash64(C.text_of(text_col)).alias("__own_hash"))

    taken = own(docs).join(plan.where("n = 1").hint("merge"), on).select("__row", "copies")
    again = plan.where("n > 1")
    if not again.isEmpty():
        rows = own(C.split_by_id(docs, id_col, again)[1]).join(again.hint("merge"), on)
        one = rows.groupBy("doc_id", "text_hash").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"), F.first("copies").alias("copies"))
        taken = taken.unionByName(one.select("__row", "copies"))
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, source_size * 3 AS room FROM s),
r AS (SELECT *, sum(source_size) OVER () AS total, sum(room) OVER () AS room_all,
        sum(weight) OVER (ORDER BY room / weight, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
        sum(room) OVER (ORDER BY room / weight, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS room_left FROM w),
l AS (SELECT *, total - (room_all - room_left) AS lft FROM r),
c AS (SELECT *, room * left_weight <= lft * weight AS capped FROM l),
t AS (SELECT source, source_size,
        CASE WHEN capped THEN CAST(room AS DOUBLE) ELSE
          CAST(max(CASE WHEN NOT capped THEN lft END) OVER () * weight AS DOUBLE) / CAST(sum(CASE WHEN NOT capped THEN weight ELSE 0 END) OVER () AS DOUBLE) END AS target FROM c),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
        CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id) - 1 AS DOUBLE) AS nth,
        CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(d.source, chr(0) || 'null')), 1, 4) AS INT) AS DOUBLE) / 65536 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN floor((nth + 1) * expected + u) - floor(nth * expected + u) ELSE 0 END AS BIGINT) * size AS taken
FROM n
"""
