"""Every registered query against its SQL."""

import compare
import pytest

from tallow import catalog

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connection()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    query = catalog.queries()[name]
    if name in ORACLE:
        assert compare.difference(spark, con, query, ORACLE[name]) == ""
    else:
        rows = {"neardup_clusters": "documents", "pca_top1": "(SELECT DISTINCT label FROM embeddings)"}[name]
        assert query(spark, compare.SF).count() == con.execute(f"SELECT count(*) FROM {rows}").fetchone()[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
