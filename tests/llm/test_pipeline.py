import os

import __spark_entry__
import corpus_pipeline
import pytest
from symgrove.llm import packing, queries
from tests.oracle import compare, duck

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert docs.columns == columns and (name == "mixing" or len(rows) <= before)
        before = len(rows)
    want = sorted((r["doc_id"], r["n_ids"], bytes(r["words"])) for r in packing.token_blocks(docs).collect())
    got = sorted((r["doc_id"], r["n_ids"], bytes(r["words"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(got) > 50


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, queries.QUERIES[name], queries.SQL[name]) == ""


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [*(f"op{i}" for i in range(1, 11)), "perturbed"]
    assert {*queries.QUERIES, "pipeline"} <= __spark_entry__.queries().keys()
