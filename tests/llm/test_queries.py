"""The operators' queries against their SQL, and their shape."""

import numpy as np
import pytest

import __spark_entry__ as entry
from test_oracles import SF, duck, same  # noqa: F401  duck is a fixture

NAMES = sorted(k for k in entry.queries() if k.startswith("op"))


@pytest.mark.parametrize("name", sorted(set(NAMES) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(NAMES) - set(entry.oracle_sql())))
def test_query_covers_its_table(spark, name):
    table, key = ("embeddings", "vec_id") if name == "op12_whitening" else ("documents", "doc_id")
    rows = entry.queries()[name](spark, SF).select(key).distinct().count()
    assert rows == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()


def test_whitening_on_its_table(spark):
    """The columns of the contract against numpy on the whole table."""
    x = np.array([[int(np.floor(64 * float(e))) + 1_000_000 for e in r.embedding] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()])
    n, s = len(np.unique(x, axis=0)), np.unique(x, axis=0).sum(axis=0)
    y = np.unique(x, axis=0) - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:16], q[:, ::-1][:, :16]
    got = entry.queries()["op12_whitening"](spark, SF).orderBy("vec_id", "component").toPandas()
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] <= 1e-4
    assert got["deviation"].tolist() == np.repeat(((n * x - s) ** 2).sum(axis=1), 16).tolist()
    assert np.allclose(got["explained"], np.tile(e / np.trace(y.T @ y / n), len(x)), rtol=1e-9)
    z = got["whitened"].to_numpy().reshape(-1, 16)
    want = (x - s / n) @ q / np.sqrt(e)
    assert np.allclose(z * np.sign((z * want).sum(axis=0)), want, atol=1e-6)
