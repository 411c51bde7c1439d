"""The pipeline against the plain operators, and the registry of this subpackage."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import check
import corpus_pipeline
from leadloom.llm import bpe_words, common, crf_lines, mixing, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert check.compare(queries.QUERIES[name](spark, sf), check.connect(sf), queries.SQL[name]) == ""


def test_every_stage_does_what_its_operator_decides(spark):
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.staged(stage(spark, docs, SF), "test-stage")
        assert out.columns == docs.columns
        before, after = {r.doc_id for r in docs.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before and out.count() == len(after)
        kept[name] = before, after, docs
        docs = out

    before, after, own = kept["toxicity"]
    scored = toxicity.scored(own, toxicity.learn(own, labels))
    assert after == {r.doc_id for r in scored.filter("predicted = 0").collect()}
    before, after, own = kept["quality rules"]
    judged = crf_lines.judged(own, crf_lines.learn(own, labels))
    assert after == {r.doc_id for r in judged.filter("kept").collect()}
    before, after, own = kept["near duplicates"]
    assert after == {r.component_id for r in simhash.classes(own).collect()}
    before, after, own = kept["mixing"]
    assert after == {r.doc_id for r in mixing.selected(own, epochs=1).collect()}

    encode = bpe_words.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).encode_ordinary
    want = {(r.doc_id, hashlib.sha256(np.array(encode(r.text), "<u4").tobytes()).hexdigest())
            for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.ids_sha256) for r in rows} == want


def test_stages_take_odd_and_empty_tables(spark):
    docs = common.table(spark, SF, "documents")
    odd = docs.limit(40).unionByName(docs.limit(3)).withColumns(
        {"score": F.lit("x"), "kept": F.lit(0), "fp": F.lit(None).cast("int")})
    odd = odd.unionByName(odd.limit(2).withColumn("text", F.lit(None).cast("string")))
    odd = odd.unionByName(odd.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(odd.limit(9).withColumn("text", F.concat("text", F.lit("\n\u00a0\n\u3000\n\x85"))))
    for start in (odd, odd.limit(0)):
        rows = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = common.staged(stage(spark, rows, SF), "test-stage")
            assert rows.columns == odd.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert last.count() == rows.count()
