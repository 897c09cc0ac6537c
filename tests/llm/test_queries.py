"""The registered queries on the smallest tables, and the pipeline against its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from evidra.llm.queries import ORACLES, QUERIES
from evidra.tables import NAMES
from tools.check_queries import rows_of

DATA = os.environ.get("EVIDRA_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="input tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    assert got and len(set(c.lower() for c in df.columns)) == len(df.columns)
    if name in ORACLES:
        cur = db.execute(ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(cols, cur.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = docs.cache()
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert not [d for d in kept if labels.get(d) == 0]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == kept
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
