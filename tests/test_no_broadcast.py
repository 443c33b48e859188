"""Joins of tables that grow pass no table through the driver."""

from pyspark.sql import functions as F

from tessera.jobs import inputs
from tessera.model import Mesh, fat_faces
from tessera.operators import reindex, topology
from tessera.sources.scratch import table


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_scratch_tables_are_merged(spark):
    a = table(spark.range(1000).select("id", (F.col("id") % 7).alias("x")))
    b = a.groupBy("x").agg(F.count("*").alias("n"))
    assert "Broadcast" not in _plan(a.join(b, "x"))
    assert "Broadcast" not in _plan(a.join(a.select(F.col("id").alias("x"), F.col("x").alias("y")), "x", "left"))


def test_joins_of_inputs_are_merged(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    points = inputs.soup_points(spark, str(tmp_path))  # sixty rows for each supplier, which Spark's estimate leaves out
    assert "Broadcast" not in _plan(points.join(points.select("mesh_id", "vid", F.col("x").alias("w")), ["mesh_id", "vid"]))


def test_joins_of_terrain_and_concatenated_meshes_are_merged(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("c_custkey"), (F.col("id") % 7 / 2).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    m = inputs.terrain(spark, str(tmp_path))  # faces that come from a join
    assert "Broadcast" not in _plan(fat_faces(reindex.concatenated(m, m)))
    turned = m.faces.withColumn("vids", F.when(F.col("fid") % 7 < 2, F.reverse("vids")).otherwise(F.col("vids")))
    assert "Broadcast" not in _plan(topology.orient_consistently(Mesh(turned, m.points)).join(m.faces, "fid"))
    n = fat_faces(m).select("mesh_id", "fid", "pts")
    assert "Broadcast" not in _plan(topology.face_link(m.faces).join(n, ["mesh_id", "fid"]))
