"""Every registered query of the package against its SQL, or its own check, on the smallest data set."""

import collections

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from oracle import connect, difference
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_all_are_registered():
    numbers = sorted(int(q[2:].split("_")[0]) for q in QUERIES)
    assert numbers == list(range(1, 14))
    assert QUERIES.keys() | {"pipeline"} <= entry.queries().keys()


@pytest.mark.parametrize("name", ["op2_sharding", "op4_mixing", "op6_near_duplicates", "op7_licenses", "op9_quality", "op11_fingerprints", "op13_merkle"])
def test_a_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in docs)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns and new.schema == docs.schema
        kept = {r.doc_id for r in new.collect()}
        assert kept <= ids and len(kept) > len(ids) // 2, name
        docs, ids = spark.createDataFrame(new.collect(), docs.schema), kept
    out = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    count = collections.Counter(r.shard for r in out)
    assert sum(count.values()) == docs.count() and max(count.values()) - min(count.values()) <= 1
