"""Every query of the reference's operators against its SQL."""

import pytest

from quillgraph import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(compare, name):
    compare(queries.QUERIES[name], queries.ORACLES[name])


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert 0 < len(rows) <= 20
    assert [r.day for r in rows] == sorted((r.day for r in rows), reverse=True)


def test_keyset_walk_reaches_every_order(spark, sf_dir):
    import pyarrow.parquet as pq

    got = [r.address for r in queries.QUERIES["keyset_all_pages"](spark, sf_dir).orderBy("rn").collect()]
    keys = pq.read_table(f"{sf_dir}/orders.parquet", columns=["o_orderkey"]).column(0).to_pylist()
    assert len(got) == len(keys) > 1000 and set(got) == {f"Mixed:{k}" for k in keys}
