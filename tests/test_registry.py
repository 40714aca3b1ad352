"""Every registered query against its SQL twin (DuckDB) on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from codeatlas.plans import registry
from codeatlas.sources.tables import DRIVER_TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracle_sql())


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    sql_types = {c[0]: str(c[1]) for c in con.execute(f"select * from ({E.oracle_sql()[name]}) limit 0").description}
    assert spark_types == sql_types
    got = sdf.toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert [f.name for f in df.schema.fields] == ["label", "rel_path", "best_rank", "hits", "batch_no", "oversize"]
