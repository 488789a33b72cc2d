"""The registered queries and the pipeline on whole small tables."""

import zlib

import pytest
from compare import connect, difference

import corpus_pipeline
from tracelake.llm.oracles import ORACLES
from tracelake.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


def test_language_and_toxicity_folds(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = QUERIES["op1_language_id"](spark, sf_dir).collect()
    assert len(found) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    found = QUERIES["op8_toxicity"](spark, sf_dir).collect()
    assert len(found) == n and all(r.predicted == int(r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)


def test_stages(spark, sf_dir):
    """Each stage keeps the columns and does to the rows what its operator's query says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity",
        "line_dedup",
        "near_duplicates",
        "decontamination",
        "byte_bpe",
    ]
    stages = dict(corpus_pipeline.STAGES)
    clean = {r.doc_id for r in QUERIES["op8_toxicity"](spark, sf_dir).collect() if not r.predicted}
    kept = stages["toxicity"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    short = {r.doc_id: r.n_lines - r.n_dropped for r in QUERIES["op9_line_dedup"](spark, sf_dir).collect()}
    lines = stages["line_dedup"](spark, docs, sf_dir)
    assert lines.columns == docs.columns
    for r in lines.collect():
        assert len(r.text.split("\n")) == max(1, short[r.doc_id]) and r.n_chars == len(r.text)
    one = {r.doc_id for r in QUERIES["op10_near_duplicates"](spark, sf_dir).collect() if r.kept}
    near = stages["near_duplicates"](spark, docs, sf_dir)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == one
    leaks = {r.doc_id for r in QUERIES["op5_benchmark_leaks"](spark, sf_dir).collect()}
    left = stages["decontamination"](spark, docs, sf_dir)
    assert left.columns == docs.columns and leaks
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - leaks
    tokens = {r.doc_id: r.ids_sha256 for r in QUERIES["op2_byte_bpe"](spark, sf_dir).collect()}
    assert {r.doc_id: r.ids_sha256 for r in stages["byte_bpe"](spark, docs, sf_dir).collect()} == tokens


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert found and all(r.n_tokens == len(r.token_ids) for r in found)
    assert len({r.doc_id for r in found}) == len(found)


def test_the_stage_keeps_one_row_of_each_group(spark, sf_dir):
    a, b = " ".join(f"a{n}" for n in range(60)), " ".join(f"b{n}" for n in range(60))
    rows = [(1, a, "x"), (1, a, "y"), (1, a + " end", "x"), (2, a, "x"), (1, b, "x"), (7, b + " end", "x")]
    rows += [(None, "only null ids", "x"), (None, "Only null ids", "y"), (None, "another text", "x")]
    rows += [(3, "", "x"), (3, "", "x"), (4, None, "x"), (5, None, "x"), (None, " ", "x"), (None, " ", "x")]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, source string").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    found = [(r.doc_id, (r.text or "").lower().removesuffix(" end")) for r in kept.collect()]
    want = [(1, a), (1, b), (None, "only null ids"), (None, "another text"), (3, ""), (4, ""), (5, ""), (None, " ")]
    assert sorted(found, key=repr) == sorted(want, key=repr)
