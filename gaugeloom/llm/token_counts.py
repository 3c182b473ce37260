"""Token counts through a cache of content digests.

Each text's digest is looked up among the counts stored for this version of the tokenizer. Of the
texts that aren't there, each distinct one is encoded once, and its count is appended to the cache.

Only digests are shuffled, apart from the texts that two filters of fixed size can't settle: those of
distinct misses that may occur more than once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .id_store import library_encoder

CACHE_SCHEMA = "digest binary, n_tokens long"
#: Characters that are cut into pieces at once: pieces take many times the room of their text.
SLICE = 1 << 20


def tokenizer_version(path: str) -> str:
    """Digest of what decides a count: the vocabulary file's bytes, and the library with its version."""
    library = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + f.read()).hexdigest()


def _spec(path: str) -> dict:
    if path.endswith(".model"):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def content_digest(text: Column, path: str) -> Column:
    """SHA-256 of the text as the vocabulary file normalises it: texts with one digest have one count.

    Files without a normaliser, and models of sentencepiece, take texts as they stand. A text that
    holds a special token goes by its own characters, since that is found before normalising.
    """
    spec = _spec(path)
    if not spec.get("normalizer"):
        return F.unhex(F.sha2(text, 256))
    special = [t["content"] for t in spec.get("added_tokens", [])]

    @F.arrow_udf(T.BinaryType())
    def digest(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        normalise = Tokenizer.from_file(path).normalizer.normalize_str
        told = (b"as is\n" + t.encode() if any(s in t for s in special) else b"normalised\n" + normalise(t).encode() for t in texts.to_pylist())
        return pa.array([hashlib.sha256(t).digest() for t in told], pa.binary())

    return digest(text)


#: A worker keeps a file's counter from task to task.
_COUNTERS: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts by the file's library, without begin, end or added special tokens."""
    if path not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        before = _spec(path).get("pre_tokenizer") or {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _COUNTERS[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        elif before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not _spec(path).get("normalizer"):
            encode = library_encoder(path)()  # equal pieces are encoded once
            _COUNTERS[path] = lambda texts: [len(x) for x in encode(texts)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _COUNTERS[path] = lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return _COUNTERS[path]


def _sliced(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _counted(texts: DataFrame, path: str) -> DataFrame:
    """digest and n_tokens of rows of (digest, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            if b.num_rows:
                counts = [n for some in _sliced(b.column(1).to_pylist()) for n in count(some)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, CACHE_SCHEMA)


def _encode_misses(texts: DataFrame, looked: DataFrame, path: str) -> DataFrame:
    """Counts of the distinct texts without one. texts: (digest, text) of all rows; looked: (digest, copies, n_tokens).

    A row surely not in the first filter has a count. One surely not in the second is the only row of
    its digest and is encoded where it is read. What both may hold meets by digest, one text each task.
    """
    spark, key = texts.sparkSession, F.xxhash64("digest")
    missing = looked.where("n_tokens is null")
    lacking = C.key_filter(missing.select(key.alias("h")), "h")
    shared = C.key_filter(looked.where("n_tokens is not null or copies > 1").select(key.alias("h")), "h")
    open_rows = texts.where(C.maybe_in(spark, lacking, key))
    sole = open_rows.where(~C.maybe_in(spark, shared, key))
    some = open_rows.where(C.maybe_in(spark, shared, key)).groupBy("digest").agg(F.first("text").alias("text"))
    some = some.join(missing.select("digest").hint("merge"), "digest", "left_semi")
    return _counted(sole, path).unionByName(_counted(some, path))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), from_cache.

    tokenizer: a vocabulary file of the tokenizers library (.json) or of sentencepiece (.model), at one
    path on every machine. cache: a folder that driver and executors share; counts stand in one table
    for each version of a tokenizer, and what this call encodes is appended to it. An interrupted call
    appends nothing; two that run at once may both append a digest, with one count.

    A null text counts as empty, and an empty text has no tokens. Rows that repeat a text or a doc_id
    stay rows of their own, a null doc_id stays null, an empty table gives an empty result and leaves
    the cache as it was. Other columns are ignored.
    """
    spark, table = docs.sparkSession, f"{cache.rstrip('/')}/version={tokenizer_version(tokenizer)}"
    C.bound_batches(spark)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(table)
    known = spark.read.schema(CACHE_SCHEMA).parquet(table).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    text = C.text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text, tokenizer).alias("digest"))
    rows = C.stored(rows, "token-digests")
    looked = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(known, "digest", "left")
    looked = C.stored(looked, "token-lookups")
    fresh = C.stored(_encode_misses(docs.select(content_digest(text, tokenizer).alias("digest"), text.alias("text")), looked, tokenizer), "token-counts")
    if not fresh.isEmpty():
        fresh.write.mode("append").option("compression", "zstd").parquet(table)
    counts = looked.where("n_tokens is not null").select("digest", "n_tokens", F.lit(True).alias("from_cache")).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    n = F.when(F.col("n_tokens").isNull(), F.raise_error(F.lit("a text changed while its tokens were counted")).cast("long")).otherwise(F.col("n_tokens"))
    # digests grow with the table: merged at every size, and what one text's copies skew is split
    return rows.join(counts.hint("merge"), "digest", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "from_cache")
