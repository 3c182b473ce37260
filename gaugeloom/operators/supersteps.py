"""Iterative dataflow: tables in the shared folder between rounds, so lineage never grows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def grow(seed: DataFrame, step, keys: list[str], name: str, most: int = 10_000) -> DataFrame:
    """Rows reachable from seed: step(frontier, round) gives candidates; known keys never come again."""
    known = frontier = stored(seed, name)
    for i in range(1, most + 1):
        new = stored(step(frontier, i).join(known.select(*keys), keys, "left_anti").dropDuplicates(keys), name)
        if new.isEmpty():
            break
        known, frontier = known.unionByName(new), new  # each part is a table
    return known


def globally_ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with rank, from 1 in the given order, and part, the number of its range.

    Rows are dealt by range and numbered inside; only one count a part meets in one task.
    """
    own = df.repartitionByRange(*order).sortWithinPartitions(*order)
    own = stored(own.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), name)
    counts = own.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("seq"))
    return own.withColumn("inside", inside).join(F.broadcast(counts), "part").withColumn("rank", F.col("before") + F.col("inside")).drop("seq", "inside", "before")  # counts: one row a part


def running_in_blocks(df: DataFrame, key: str, block: str, order: str, sums: dict[str, str], name: str) -> DataFrame:
    """df with running sums (column to its sum's name), this row included, over the rows of a key in their order.

    block: a coarser number that rises with the order. Rows of a block meet in one task, and of a key
    only one row a block.
    """
    own = stored(df, name)
    totals = own.groupBy(key, block).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, block, *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy(key, block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({s: F.sum(c).over(inside) for c, s in sums.items()})
    return own.join(totals, [key, block]).withColumns({s: F.col(s) + F.col(f"__{c}") for c, s in sums.items()}).drop(*[f"__{c}" for c in sums])
