"""Each query against its SQL, and the driver's contract."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from driftmark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v + 0.0:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf, sql, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = sql.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_explained_variance_falls(spark, sf):
    ratio = [r.ratio for r in catalogue.QUERIES["pca_explained_variance"](spark, sf).orderBy("component").collect()]
    assert ratio == sorted(ratio, reverse=True) and 0.95 <= sum(ratio) + 1e-4 <= 1.0001


def test_covariance_of_all_components(spark, sf):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], float)
    got = {(r.i, r.j): r.cov for r in catalogue.QUERIES["covariance_matrix_all"](spark, sf).collect()}
    want = np.cov(x, rowvar=False)
    assert len(got) == x.shape[1] ** 2 and all(abs(got[i, j] - v) < 2e-6 for (i, j), v in np.ndenumerate(want))
    assert all(got[r.i, r.j] == r.cov for r in catalogue.QUERIES["covariance_matrix"](spark, sf).collect())
