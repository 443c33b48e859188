"""Queries without SQL read every row of their tables."""

import pytest

from tessera.jobs import inputs, queries


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("orders"))
    rows = [(k, 5100 + k) for k in (1, 2, 4, 7, 11)]  # no multiple of 3 or 5
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{base}/orders.parquet")
    return base


@pytest.mark.parametrize("name", ["t19_connect_edges", "t21_eulerian_paths", "c5_clean_curves"])
def test_paths_run_over_every_order(spark, orders, name):
    assert sum(r.n - 1 for r in queries.QUERIES[name](spark, orders).collect()) == 5


def test_every_face_is_oriented(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([(7, 1, 0, 1), (7, 2, 0, 1), (24, 5, 0, 2)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long").write.parquet(f"{base}/lineitem.parquet")
    spark.createDataFrame([(0,)], "s_suppkey long").write.parquet(f"{base}/supplier.parquet")
    assert queries.QUERIES["t16_orient_consistently"](spark, base).count() == inputs.soup_faces(spark, base).count() == 2
