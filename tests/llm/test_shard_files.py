"""Shards are rows of megabytes: a file holds few of them, however many a task indexes."""

import glob

import pyarrow.parquet as pq

from gaugeloom.llm import collocations, common


def test_a_file_holds_few_shards(spark):
    """One task, and texts that fill a shard each."""
    root, path = common.scratch_root(spark).removeprefix("file://"), "tables/phrase-shards-*"
    before = set(glob.glob(f"{root}/{path}"))
    docs = spark.createDataFrame([("en", "red green blue.\n" * (collocations.SHARD_CHARS // 16)) for _ in range(6)], "lang string, text string").coalesce(1)
    got = {(r.phrase, r.a) for r in collocations.collocations(docs).collect()}
    assert ("red green blue", 6 * (collocations.SHARD_CHARS // 16)) in got
    (folder,) = set(glob.glob(f"{root}/{path}")) - before
    rows = [pq.read_metadata(f).num_rows for f in glob.glob(f"{folder}/*.parquet")]
    assert sum(rows) == 6 and max(rows) == collocations.FILE_SHARDS
