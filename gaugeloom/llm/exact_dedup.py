"""Exact deduplication by a log-structured merge index.

Level 0 is built where the documents are read: each task keeps a memtable of digests, verifies hits
byte by byte against the text it holds, and flushes it as a run, sorted by digest, with a filter of
the run's digests. Runs are rows of a table in the shared folder. Filters of all runs together tell
which digests can be in two runs; only those entries take part in the two compactions, which merge
sorted runs and verify bytes again. Compaction keeps the best identifier of each text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Bytes of text that a memtable holds before it is flushed, and runs that a first compaction merges.
MEMTABLE_BYTES, FAN_IN = 16 << 20, 32


def _better(a: tuple, b: tuple) -> bool:
    """a = (code points, doc_id): more code points first, then the smaller doc_id, null last."""
    if a[0] != b[0]:
        return a[0] > b[0]
    return a[1] is not None and (b[1] is None or a[1] < b[1])


def _key(sha: str) -> int:
    return int(sha[:16], 16) - (1 << 63)


def _runs(id_type: pa.DataType, digest_chars: int, memtable_bytes: int):
    """Level 0: (doc_id, n_points, sha, norm) to the rows of sorted runs, and their filters."""
    names = ["run", "seq", "digest", "sha", "doc_id", "n_points", "head", "head_id", "head_points", "members", "norm", "chunk", "bits"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), id_type, pa.int32(), pa.bool_(), id_type, pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary()]

    def flush(run: int, table: dict[str, list[list]]) -> Iterator[pa.RecordBatch]:
        rows, seq = [], 0
        for digest in sorted(table):
            for norm, members in table[digest]:
                best = members[0]
                for m in members:
                    if _better(m[:2], best[:2]):
                        best = m
                for m in members:
                    rows.append((run, seq, digest, m[2], m[1], m[0], m is best, best[1], best[0], len(members), norm if m is best else None, None, None))
                seq += 1
        keys = np.array([_key(x.ljust(16, "0")) for x in table], np.int64)
        rows += [(run, None, None, None, None, None, False, None, None, None, None, c, bits) for c, bits in C.filter_rows(keys)]
        for i in range(0, len(rows), 2000):
            cols = list(zip(*rows[i : i + 2000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushed, held, table = TaskContext.get().partitionId(), 0, 0, {}
        for b in batches:
            for doc, points, sha, norm in zip(*(c.to_pylist() for c in b.columns)):
                entries = table.setdefault(sha[:digest_chars], [])
                for e in entries:
                    if e[0] == norm:  # a hit counts only if the bytes agree
                        e[1].append((points, doc, sha))
                        break
                else:
                    entries.append([norm, [(points, doc, sha)]])
                    held += len(norm)
                held += 150
                if held > memtable_bytes:
                    yield from flush(part << 24 | flushed, table)
                    flushed, held, table = flushed + 1, 0, {}
        if table:
            yield from flush(part << 24 | flushed, table)

    return run


def _compaction(id_type: pa.DataType):
    """Merge entries that come sorted by (digest, norm): equal neighbours become one entry.

    Each entry gets a row with the merged entry's place (run, seq); the first of them also carries
    the merged entry itself.
    """
    names = ["run", "seq", "to_run", "to_seq", "first", "digest", "norm", "keep_id", "keep_points", "keep_run", "keep_seq", "members"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), id_type, pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, best, total, out = None, [], None, 0, []

        def close() -> None:
            lead = places[0]
            for i, (r, s) in enumerate(places):
                one = (*at, best[1], best[0], best[2], best[3], total) if i == 0 else (None,) * 7
                out.append((r, s, *lead, i == 0, *one))

        def taken() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            for r, s, digest, norm, doc, points, k_run, k_seq, members in zip(*(c.to_pylist() for c in b.columns)):
                if at != (digest, norm):  # byte verification: equal digests with other bytes stay apart
                    if at is not None:
                        close()
                    at, places, best, total = (digest, norm), [], (points, doc, k_run, k_seq), 0
                places.append((r, s))
                total += members
                here = (points, doc, k_run, k_seq)
                if _better(here[:2], best[:2]) or (here[:2] == best[:2] and here[2:] < best[2:]):
                    best = here
            if len(out) > 1000:
                yield taken()
        if at is not None:
            close()
        if out:
            yield taken()

    return merge


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_chars: int = 32, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting blanks; of equal texts the row with the most code
    points in the original text, then the smallest doc_id, stays (exactly one row of a group is kept,
    also among repeated rows). Null texts count as empty, and empty texts are one group. A null
    doc_id is the last choice. An empty table gives an empty result. Other columns are ignored.
    digest_chars: hex digits of SHA-256 in the index; bytes decide, so short digests only cost work.
    """
    spark = docs.sparkSession
    C.bound_batches(spark)
    text = C.text_of(text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), F.length(text).alias("n_points"), F.translate(text, C.BLANKS, "").alias("norm"))
    src = src.select("doc_id", "n_points", F.sha2("norm", 256).alias("sha"), "norm")
    id_type = src.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    if id_type not in ("bigint", "int", "string"):
        raise TypeError(f"{id_col} must be long, int or string, not {id_type}")
    runs = C.stored(
        src.mapInArrow(
            _runs(arrow_id, digest_chars, memtable_bytes),
            f"run long, seq int, digest string, sha string, doc_id {id_type}, n_points int, head boolean, head_id {id_type}, head_points int, members long, norm string, chunk int, bits binary",
        ),
        "exact-runs",
    )
    bits = C.merge_filters(runs.where("chunk is not null").select("chunk", "bits"), twice=True)
    prefix = F.rpad(F.substring("digest", 1, 16), 16, "0")
    key = (F.conv(F.substring(prefix, 1, 8), 16, 10).cast("long") - F.lit(1 << 31)) * F.lit(1 << 32) + F.conv(F.substring(prefix, 9, 8), 16, 10).cast("long")
    entries = (
        runs.where("head").where(C.maybe_in(spark, bits, key))
        .select("run", "seq", "digest", "norm", "doc_id", F.col("n_points").alias("points"), F.col("run").alias("k_run"), F.col("seq").alias("k_seq"), "members")
    )
    schema = f"run long, seq int, to_run long, to_seq int, first boolean, digest string, norm string, keep_id {id_type}, keep_points int, keep_run long, keep_seq int, members long"
    compact = _compaction(arrow_id)
    salt = F.pmod(F.xxhash64("run"), F.lit(FAN_IN))  # a digest that is in very many runs is merged in parts first
    low = C.stored(
        entries.withColumn("salt", salt).repartition("digest", "salt").sortWithinPartitions("digest", "salt", "norm")
        .drop("salt").mapInArrow(compact, schema),
        "exact-level1",
    )
    high = C.stored(
        low.where("first").select("run", "seq", "digest", "norm", F.col("keep_id").alias("doc_id"), F.col("keep_points").alias("points"), F.col("keep_run").alias("k_run"), F.col("keep_seq").alias("k_seq"), "members")
        .repartition("digest").sortWithinPartitions("digest", "norm").mapInArrow(compact, schema).drop("norm"),
        "exact-level2",
    )
    # entry -> its place after the first compaction -> after the second -> the merged entry
    top = high.where("first").select(F.col("run").alias("to_run"), F.col("seq").alias("to_seq"), "keep_id", "keep_run", "keep_seq", F.col("members").alias("size"))
    merged = high.select(F.col("run").alias("l_run"), F.col("seq").alias("l_seq"), "to_run", "to_seq").join(top, ["to_run", "to_seq"]).drop("to_run", "to_seq")
    found = low.select("run", "seq", F.col("to_run").alias("l_run"), F.col("to_seq").alias("l_seq")).join(merged, ["l_run", "l_seq"]).drop("l_run", "l_seq")
    rows = runs.where("chunk is null").select("run", "seq", "sha", "doc_id", "head", "head_id", "members")
    alone = F.col("size").isNull()
    return rows.join(found, ["run", "seq"], "left").select(
        "doc_id",
        F.when(alone, F.col("head_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", "members").alias("group_size"),
        (F.col("head") & (alone | ((F.col("keep_run") == F.col("run")) & (F.col("keep_seq") == F.col("seq"))))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that exact_dedup keeps, with all their columns.

    A row is found again by doc_id and the normalised text's digest; of rows that repeat both, the
    one with the most code points stays. Only rows that share a doc_id with a dropped one are
    shuffled, so most texts stay where they are read.
    """
    told = exact_dedup(docs, id_col, text_col, **options).where("group_size > 1").groupBy("doc_id", "text_sha256")
    told = told.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    told = C.stored(told, "exact-told")
    rest, some = C.split_by_id(docs, id_col, told)
    text = C.text_of(text_col)
    some = some.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.sha2(F.translate(text, C.BLANKS, ""), 256).alias("__sha"), F.length(text).alias("__points"))
    joined = some.join(told.hint("merge"), F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__sha") == F.col("text_sha256")), "left")
    first = Window.partitionBy("__id", "__sha").orderBy(F.col("__points").desc())
    repeated = F.coalesce(F.col("kept"), F.lit(False))  # kept, but in more rows than one
    one = joined.where(repeated).withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return rest.unionByName(joined.where(F.col("n").isNull()).select("__row.*")).unionByName(one.select("__row.*"))
