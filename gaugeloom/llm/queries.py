"""Queries of the text operators, as __spark_entry__ registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, common, exact_dedup, id_store, line_dedup, minhash, mixing, pii, quality_classifier, quality_rules, spelling, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "id-store")
    id_store.write_ids(_table(spark, sf_dir, "documents"), path, id_store.library_encoder(public_tokenizers.path("byte_bpe_50k.json")))
    return id_store.read_checksums(spark, path)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = common.scratch_path(spark, "token-cache")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_toxicity, op3_id_store, op4_quality_rules, op5_quality_classifier, op6_line_dedup, op7_bpe, op8_minhash, op9_mixing, op10_pii, op11_token_counts, op12_spelling_variants, op13_collocations, pipeline)}


EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS text_sha256 FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS nth,
        first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, text_sha256 FROM g
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i + 1 : i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, sh FROM s),
e AS (SELECT doc_id, n, unnest(sh) AS g FROM n),
f AS (SELECT g, count(*) AS df FROM e GROUP BY g),
r AS (SELECT e.doc_id, e.n, e.g, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.df, e.g) AS nth FROM e JOIN f USING (g)),
p AS (SELECT doc_id, n, g FROM r WHERE nth <= n - ceil(0.85 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * len(list_intersect(a.sh, b.sh)) >= 85 * (a.n + b.n - len(list_intersect(a.sh, b.sh)))),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
t AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT u.y, t.root FROM t JOIN u ON u.x = t.id WHERE t.root < u.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT id, min(root) AS c FROM t GROUP BY id) m ON m.id = n.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT_SQL, "op6_line_dedup": line_dedup.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op12_spelling_variants": spelling.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
