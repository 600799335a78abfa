"""The registered queries and the pipeline on the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cashlens.llm import dedup, pieces, quality, secrets
from cashlens.llm.queries import ORACLES, QUERIES
from tools.check_queries import compare, connect

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(QUERIES) <= set(names) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    error, n = compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
    assert error is None and n > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)

    good = stage["quality_filter"](spark, docs, SF)
    rejected = {r.doc_id for r in quality.contract(docs, labels).where("predicted = 0").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect()} - rejected

    single = stage["near_duplicates"](spark, docs, SF)
    kept = {r.doc_id for r in dedup.near_duplicates(docs).where("kept").collect()}
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(kept)

    clean = {r.doc_id: r for r in stage["secret_redaction"](spark, docs, SF).collect()}
    for r in docs.collect():
        base, lexed = secrets.all_spans(r.text)
        assert (clean[r.doc_id].text == r.text) == (not base and not lexed)
        assert not secrets.base_spans(clean[r.doc_id].text) and clean[r.doc_id].n_chars == len(clean[r.doc_id].text)

    mixed = stage["source_mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.count() > docs.count()

    model = pieces.load()
    for r in stage["piece_encoding"](spark, docs, SF).limit(20).collect():
        assert len(r.ids) == r.n_tokens and pieces.decode_ids(model, r.ids)


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
