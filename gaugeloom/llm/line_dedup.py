"""Line dedup by overlapping three-line windows.

Each run of three consecutive lines is hashed; a window found again anywhere later in the corpus
(by doc_id, then place) covers its three lines, and covered lines are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LINES = 3


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """Later occurrences of repeated windows: doc_id, text_hash, pos (line number of the window's first line, from 0).

    Only hashes, identifiers and places are shuffled. Hashes are the first 16 bytes of SHA-256.
    """
    split = F.split(C.text_of(text_col), "\n")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(C.text_of(text_col)).alias("text_hash"), split.alias("lines"))
    rows = rows.where(F.size("lines") >= lines)
    window = F.transform(F.sequence(F.lit(0), F.size("lines") - lines), lambda i: F.substring(F.unhex(F.sha2(F.array_join(F.slice("lines", i + 1, lines), "\n"), 256)), 1, 16))
    windows = C.stored(rows.select("doc_id", "text_hash", F.posexplode(window).alias("pos", "hash")), "line-windows")
    # The first occurrence by (doc_id, text_hash, pos), null doc_id last; rows that repeat doc_id and text are one document.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "pos")
    firsts = windows.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    firsts = C.stored(firsts.select("hash", F.col("first")), "line-firsts")
    again = windows.join(firsts, "hash").where(~place.eqNullSafe(F.col("first")))
    return again.select("doc_id", "text_hash", "pos")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text (without the removed lines).

    Lines are what "\\n" separates, compared as they stand; a null text counts as empty (one empty
    line). A text of fewer than three lines has no window and stays whole. Within a document the
    windows of a repeated block overlap, so covered lines are merged. Rows that repeat doc_id and text
    are one document and all keep the same lines. An empty table gives an empty result. Other columns
    are ignored.
    """
    again = repeated_windows(docs, id_col, text_col, lines)
    covered = again.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("starts"))
    covered = C.stored(covered, "line-covered").withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    own = docs.select(F.col(id_col).alias("doc_id"), C.text_of(text_col).alias("text"), F.xxhash64(C.text_of(text_col)).alias("__own"))
    # covered grows with the table: merged at every size, never broadcast
    joined = own.join(covered.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    split = F.split("text", "\n")
    hit = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + lines - 1))))
    joined = joined.withColumn("__lines", split).withColumn("__hit", F.when(F.col("starts").isNotNull(), hit))
    kept = F.array_join(_without("__lines", "__hit"), "\n")
    return joined.select(
        "doc_id",
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__hit"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("starts").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


def _without(lines: str, hit: str):
    """Lines whose number isn't hit: both are sorted by number, and lines between two neighbouring hits stay."""
    edges = F.concat(F.array(F.lit(-1)), F.array_sort(hit), F.array(F.size(lines)))
    gaps = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges)), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(F.filter(gaps, lambda x: x.isNotNull()))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(len(lines) - 2)) AS pos, lines FROM d WHERE len(lines) >= 3),
h AS (SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS win FROM w),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM h),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE nth > 1),
l AS (SELECT doc_id, unnest(lines) AS line_text, unnest(range(len(lines))) AS line FROM d),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.line) AS n_removed,
        string_agg(CASE WHEN c.line IS NULL THEN line_text END, chr(10) ORDER BY l.line) AS text
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.line = c.line GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, coalesce(text, '') AS text FROM k
"""
