"""The pipeline's stages against the operators' plain versions, and its queries."""

import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from oracle import DATA, duck, rows as counted
from tallyframe.llm.queries import QUERIES, SQL
from tallyframe.session import stored
from llm.test_filters import plain_components
from llm.test_texts import plain_base

FOLDER = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stored(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "minhash_near_dedup":
            assert set(kept[name]) == {i for i, _, c, ok in plain_components(before) if ok}
        if name == "pii":
            assert not any(plain_base(t) for t in kept[name].values()) and len(kept[name]) == len(before)
    good = [i for i in kept["quality_rules"] if i in labels]
    assert good and all(labels[i] == 1 for i in good)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept["pii"])
    assert contract.queries()["pipeline"](spark, FOLDER).count() == packed.count()


def test_every_operator_has_one_query():
    for n in range(1, 14):
        assert len([k for k in contract.queries() if k.startswith(f"op{n}_")]) == 1
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, FOLDER)
    cursor = duck(FOLDER).execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(found.columns)
    assert counted(found.columns, found.collect()) == counted(names, cursor.fetchall())
