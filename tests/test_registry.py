"""Every registered query against its DuckDB SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


def shown(v):
    if hasattr(v, "tolist"):
        return str([shown(x) for x in v.tolist()])
    if v is None or not hasattr(v, "__len__") and pd.isna(v):
        return "NULL"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df, cols):
    return sorted(tuple(map(shown, r)) for r in df[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    run, sql = QUERIES[name]
    got = run(spark, SF).toPandas()
    assert len(got) > 0
    if sql:
        want = db.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_whole_inputs(spark):
    """Every document is merged, and whole texts are put into templates and between tags."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    merged = QUERIES["merge_retries"][0](spark, SF).collect()
    assert sorted(r.ord for r in merged if r.part == 0) == sorted(docs)
    assert {r.part for r in merged} == {0, 1}
    for name in ("template_fill", "tag_extract"):
        got = QUERIES[name][0](spark, SF).collect()
        assert sorted(r.doc_id for r in got) == sorted(docs) and all(docs[r.doc_id].strip() in r.text for r in got)
