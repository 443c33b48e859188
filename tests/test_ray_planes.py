"""Hits at the very ends of a ray's range count as the SQL says."""

import duckdb

from tessera.jobs import queries


def test_hits_at_the_end_of_the_range(spark, tmp_path):
    # The planes of these faces lie at 20 but for the last bits: two below it, two above.
    rows = [(11204, 1754841, 4, 49), (6343, 981616, 1, 31), (10205, 1560418, 6, 14), (3388, 456946, 2, 40)]
    tables = {"lineitem": spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber long, l_partkey long"), "supplier": spark.createDataFrame([(r[0],) for r in rows], "s_suppkey long")}
    db = duckdb.connect()
    for name, t in tables.items():
        t.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(queries.ORACLES["p10_ray_planes"]).fetchall())
    assert len(want) == 2
    assert sorted(map(tuple, queries.QUERIES["p10_ray_planes"](spark, str(tmp_path)).collect())) == want
