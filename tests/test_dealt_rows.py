"""A file of few bytes whose rows take long is dealt to more tasks as it grows."""

import pytest

from tessera.jobs import inputs, queries, queries_contact  # noqa: F401


@pytest.mark.parametrize("name", ["p7_p8_sides", "p4_polygon_and_box_distances", "p5_closest_pairs"])
def test_tasks_grow_with_rows(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(inputs, "DEALT", 10)
    rows = spark.range(95).selectExpr("id AS p_partkey", "id % 50 AS p_size", "900.0D + id AS p_retailprice").coalesce(1)
    rows.write.parquet(f"{tmp_path}/part.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 10
    assert out.select("k").distinct().count() == 95
