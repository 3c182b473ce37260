"""What several text operators share: scratch tables, distributed ranks, bounded filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters that separate words, and the pattern of a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: One Arrow batch to a Python worker holds at most so many rows and bytes, however long the texts.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20


def text_of(name: str = "text") -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts can't exhaust a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, fixes what depends on the order of
    rows, and lets a later join shuffle both sides itself, which adaptive execution can then split.
    file_rows: the most rows of a file, for rows of megabytes: a task's writer and reader hold a file's rows at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many rows a table of groups is broadcast.
FEW_ROWS, SALTS = 20_000, 64


def is_small(groups: DataFrame, few_rows: int = FEW_ROWS) -> bool:
    return groups.limit(few_rows + 1).count() <= few_rows


def join_groups(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner", small: bool | None = None) -> DataFrame:
    """rows joined with a stored table of one row a group, or a few.

    The table is counted, unless the caller has: it is broadcast up to FEW_ROWS; beyond that its rows are
    repeated over SALTS salts, so that a group of very many rows is spread over as many tasks.
    """
    if is_small(groups) if small is None else small:
        return rows.join(F.broadcast(groups), key, how)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", salt).join(spread.hint("merge"), [key, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with `before`: the sum of `value` over all rows that come earlier in the order (nulls last).

    Rows are range-partitioned and sorted; each partition is summed by itself, and only the sums of
    partitions (one row each) meet in one task. No partition holds more than its range.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    parts = stored(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"__part": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()}),
        name,
    )
    sums = parts.groupBy("__part").agg(F.sum(value).alias("__sum"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(sums), "__part")  # one row for each partition
        .withColumn("before", F.col("__base") + F.col("__inside"))
        .drop("__part", "__seq", "__inside", "__base")
    )


def fitted(sample: DataFrame, fit: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str):
    """The one row, by name, that `fit` makes of a sample of bounded size, which meets in one task.

    An empty sample may start no task at all; then the driver fits nothing.
    """
    row = sample.repartition(1).mapInArrow(fit, schema).first()
    return row if row is not None else next(fit(iter(()))).to_pylist()[0]


# Filters of a fixed size: false positives cost work, never results.
FILTER_BITS, FILTER_HASHES, FILTER_CHUNK = 1 << 25, 3, 1 << 16


def filter_places(keys: np.ndarray) -> np.ndarray:
    """Bit positions of 64-bit keys, an array of (keys, FILTER_HASHES)."""
    x = keys.astype(np.uint64)[:, None] * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def filter_rows(keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A filter as (chunk, sorted bit positions in it as int32)."""
    at = np.unique(filter_places(keys))
    for c, part in zip(*_cut(at)):
        yield c, (part % FILTER_CHUNK).astype(np.int32).tobytes()


def _cut(at: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(at):
        return [], []
    chunks = at // FILTER_CHUNK
    edges = np.flatnonzero(np.diff(chunks)) + 1
    return [int(chunks[i]) for i in [0, *edges]], np.split(at, edges)


def merge_filters(rows: DataFrame, twice: bool = False) -> bytes:
    """OR of filters given as rows (chunk int, bits binary): at most FILTER_BITS / 8 bytes reach the driver.

    twice: keep the bits that are set in two or more of the filters.
    """

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            for c, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = seen.setdefault(c, np.zeros(FILTER_CHUNK, np.uint8))
                at = np.frombuffer(bits, np.int32)
                own[at] = np.minimum(own[at] + 1, 2)
        out = [(c, np.packbits(x >= (2 if twice else 1)).tobytes()) for c, x in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["chunk", "bits"])

    whole = bytearray(FILTER_BITS // 8)
    step = FILTER_CHUNK // 8
    merged = rows.repartition("chunk").mapInArrow(merge, "chunk int, bits binary")
    for r in merged.toLocalIterator():
        whole[r["chunk"] * step : (r["chunk"] + 1) * step] = r["bits"]
    return bytes(whole)


def key_filter(df: DataFrame, key: str) -> bytes:
    """A filter over the 64-bit integers in column key."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(filter_rows(np.asarray(b.column(0).drop_null().to_numpy(zero_copy_only=False), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["chunk", "bits"])

    return merge_filters(df.select(F.col(key).cast("long")).mapInArrow(build, "chunk int, bits binary"))


def probe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter. bits: the filter's bytes as uint8."""
    at = filter_places(keys)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def maybe_in(spark: SparkSession, bits: bytes, key: Column) -> Column:
    """A condition: the 64-bit key may be in the filter. The filter, of fixed size, goes to every executor once."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf(T.BooleanType())
    def maybe(keys: pa.Array) -> pa.Array:
        known = np.asarray(keys.is_valid())
        own = np.asarray(keys.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        return pa.array(probe(np.frombuffer(shared.value, np.uint8), own) & known)

    return maybe(key.cast("long"))


def split_by_id(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: rows whose id is surely not in `ids` (column doc_id), and the others.

    What few rows of ids concern can so be found without a shuffle of all texts.
    """
    bits = key_filter(ids.select(F.xxhash64("doc_id").alias("h")), "h")
    hit = maybe_in(docs.sparkSession, bits, F.xxhash64(docs[id_col]))
    return docs.where(~hit), docs.where(hit)


def drop_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of the given (doc_id, text_hash), hashes being xxhash64 of the text."""
    rest, some = split_by_id(docs, id_col, dropped)
    gone = dropped.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    some = some.select(F.struct("*").alias("__row"), F.col(id_col).alias("__own"), F.xxhash64(text_of(text_col)).alias("__own_hash"))
    left = some.join(gone.hint("merge"), F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__own_hash") == F.col("__hash")), "left_anti")
    return rest.unionByName(left.select("__row.*"))
