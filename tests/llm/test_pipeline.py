"""The pipeline against its stages done by brute force."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeloom.llm import common, mixing, quality_rules
from tests.llm.test_operators import exact_brute, near_brute, none, odd  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    stay = {k for _, k, _, _ in exact_brute(rows)[0]}
    rows = [r for r in rows if r[0] in stay]
    stay = {c for _, _, c in near_brute(rows, 5, 80)}
    left = docs.where(docs.doc_id.isin([d for d, _ in rows if d in stay]))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(left).collect()}
    for r in left.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += plan[r.doc_id]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    assert re.fullmatch(r"[a-z ]+", " ".join(n for n, _ in corpus_pipeline.STAGES))


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):  # noqa: F811
    """Each stage by itself on nulls, repeated rows and ids, long texts and columns with clashing names, and all of them on an empty table."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = common.stored(stage(spark, odd, str(tmp_path)), "test-stage")
        assert got.columns == odd.columns, name
        rows = {(r.doc_id, r.text) for r in odd.collect()}
        assert {(r.doc_id, r.text) for r in got.collect()} <= rows, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, odd, str(tmp_path))
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in odd.collect())
    none.write.parquet(f"file://{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").collect() == []
