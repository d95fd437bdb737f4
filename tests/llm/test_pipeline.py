"""The pipeline on the smallest tables, stage by stage, and the SQL of the queries that have one."""
import collections

import pytest

import corpus_pipeline as pipeline
from wayfound.llm.common import stage
from wayfound.llm.queries import CATALOG

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, before = docs.columns, docs.count()
    for name, step in pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), name)
        assert docs.columns == cols
        if name != "mixing":
            assert 0 < docs.count() <= before
            before = docs.count()
    placed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert placed.count() == docs.count() and placed.select("shard", "slot").distinct().count() == docs.count()


@pytest.mark.parametrize("key", [k for k, (_, sql) in CATALOG.items() if sql])
def test_query_equals_sql(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    norm = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    fn, sql = CATALOG[key]
    df = fn(spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect()) == collections.Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
