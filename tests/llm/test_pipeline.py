"""The stages of the pipeline on the smallest tables, and the registered queries against SQL."""

import re
from functools import reduce

import duckdb
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from scoretide.llm.oracle import ORACLE
from scoretide.llm.queries import QUERIES


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    df = queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(cur.fetchall(), key=str)


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if k < 4:
            assert docs.columns == columns
            now = {r.doc_id: r.text for r in rows}
            assert set(now) <= set(seen) and len(rows) == len(now)
            if name == "toxicity":
                lost = [i for i in seen if i not in now]
                assert sum(labels.get(i) == 0 for i in lost) <= 0.1 * sum(x == 0 for x in labels.values())  # few labels at this size
            if name == "exact dedup":
                assert len({"".join((t or "").split()) for t in now.values()}) == len(now)
            if name == "secret scans":
                assert set(now) == set(seen)
                assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t or "") for t in now.values())
            seen = now
    assert {r.doc_id for r in rows} == set(seen)
    assert reduce(lambda a, r: a + r.length, rows, 0) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_stages_stand_odd_rows(spark, docs, sf, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() > 20


def test_stages_stand_no_rows(spark, empty, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
