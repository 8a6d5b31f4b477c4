"""The pipeline: each stage on its own input, by brute force where the stage has one, and the whole run."""

import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from ridgewatch.llm import bpe, quality_rules
from tests.llm.test_corpus_operators import components, contamination, secret_spans

SF = "/root/testdata/sf0.001"


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before = {r.doc_id: r.text for r in docs.collect()}
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.count()
        if name != "byte_level_bpe":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            verdicts = quality_rules.verdicts(spark.read.parquet(f"{SF}/documents.parquet"))
            assert set(after) == {r.doc_id for r in verdicts.where("kept").collect()}
        elif name == "ngram_jaccard_join":
            assert {str(k) for k in after} == {c for _, _, c in components(list(before.items()))}
        elif name == "benchmark_decontamination":
            assert {str(k) for k in after} == {d for d, *_, bad in contamination(list(before.items()), items) if not bad}
        elif name == "secret_scans":
            assert set(after) == set(before)
            assert all(after[k] == before[k] for k in after if not secret_spans(before[k]))
            assert all(not secret_spans(after[k]) for k in after)
        else:
            exact = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            rows = docs.collect()
            assert {r.doc_id: r.n_tokens for r in rows} == {k: len(exact.encode_ordinary(t)) for k, t in before.items()}
            assert all(r.decoded_sha256 == hashlib.sha256(before[r.doc_id].encode()).hexdigest() for r in rows)
    assert corpus_pipeline.run(spark, SF).select(F.count("*")).first()[0] == seen["byte_level_bpe"] > 0
