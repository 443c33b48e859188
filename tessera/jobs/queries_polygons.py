"""Registered queries on faces of four and more corners, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.jobs import inputs as I
from tessera.jobs.queries import TERRAIN, _round, query
from tessera.model import KEY, Mesh
from tessera.operators import cut, measures, spatial, triangulate

MOVE = (0.4, 0.3, 0.2)
#: Points in and about each supplier's box, off its sides.
SPOTS = "SELECT s_suppkey AS mesh_id, 1 + s_suppkey % 7 AS w, i, (i * 13 % 50 - 9.5::DOUBLE) / 33 * (1 + s_suppkey % 7) AS x, (i * 29 % 50 - 9.5::DOUBLE) / 33 * (1 + s_suppkey % 7) AS y, (i * 7 % 50 - 9.5::DOUBLE) / 33 * (1 + s_suppkey % 7) AS z FROM supplier, range(40) AS r(i)"


def _spots(spark, d):
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")))
    q = I.read(spark, d, "supplier").select(F.col("s_suppkey").alias(KEY), i.alias("qid"))
    return q.select(KEY, "qid", *[((F.col("qid") * k % 50 - 9.5) / 33 * (1 + F.col(KEY) % 7)).alias(c) for c, k in (("x", 13), ("y", 29), ("z", 7))])


@query(f"""WITH {TERRAIN} SELECT DISTINCT f.vids[1] AS fid, round(100 - (a.z + 0.25 * (c.z - d.z) + 0.5 * (d.z - a.z)) / 50, 8) AS t
    FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points c ON c.vid = f.vids[1] + {I.COLUMNS + 1} JOIN points d ON d.vid = f.vids[1] + {I.COLUMNS} WHERE f.fid % 2 = 0""")
def j10_ray_hits_quads(spark, d):
    """A ray down on each cell, a quarter from its left and half from its lower side."""
    m = I.quad_terrain(spark, d)
    low = m.faces.select(KEY, F.col("fid").alias("vid")).join(m.points, [KEY, "vid"])
    rays = low.select(KEY, F.col("vid").alias("ray_id"), (F.col("x") + 0.25).alias("ox"), (F.col("y") + 0.5).alias("oy"), F.lit(100.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"), F.lit(0.0).alias("min_t"), F.lit(1e9).alias("max_t"))
    return _round(spatial.ray_hits(m, rays, pieces=1), "t", digits=8).select("fid", "t")


@query(f"WITH p AS ({SPOTS}) SELECT mesh_id, i AS qid, CASE WHEN least(x, y, z) > 0 AND greatest(x, y, z) < w THEN 'inside' ELSE 'outside' END AS side FROM p")
def j11_points_in_quads(spark, d):
    return spatial.points_in_mesh(I.quad_boxes(spark, d), _spots(spark, d))


@query(f"""WITH p AS ({SPOTS}), g AS (SELECT *, greatest(-x, x - w, 0) AS gx, greatest(-y, y - w, 0) AS gy, greatest(-z, z - w, 0) AS gz FROM p)
    SELECT mesh_id, i AS qid, round(CASE WHEN gx + gy + gz > 0 THEN sqrt(gx * gx + gy * gy + gz * gz) ELSE least(x, y, z, w - x, w - y, w - z) END, 6) AS distance FROM g""")
def j1_nearest_quads(spark, d):
    near = spatial.nearest_faces(I.quad_boxes(spark, d), _spots(spark, d))
    return _round(near.select(KEY, "qid", F.sqrt("d2").alias("distance")), "distance")


@query("SELECT s_suppkey AS mesh_id, round(2 * (0.6 + 0.7 + 0.8) * (1 + s_suppkey % 7), 5) AS length, 6::BIGINT AS n_pairs FROM supplier")
def x4_quad_intersections(spark, d):
    """Where the sides of two overlapping boxes meet: the length of the curve, and its pairs of faces."""
    seg = cut.intersection_edges(I.quad_boxes(spark, d), I.quad_boxes(spark, d, MOVE)).groupBy(KEY)
    return _round(seg.agg(F.sum(P.distance(F.col("p"), F.col("q"))).alias("length"), F.countDistinct("id0", "id1").alias("n_pairs")), "length", digits=5)


@query("""SELECT s_suppkey AS mesh_id, round(0.6 * 0.7 * 0.8 * power(1 + s_suppkey % 7, 3), 5) AS inner_volume, round((2 - 0.6 * 0.7 * 0.8) * power(1 + s_suppkey % 7, 3), 5) AS union_volume FROM supplier""")
def x10_quad_volumes(spark, d):
    (inner, _), (whole, _) = cut.booleans(I.quad_boxes(spark, d), I.quad_boxes(spark, d, MOVE), "intersection", "union")
    inner = measures.volume(inner).select(KEY, F.col("signed_volume").alias("inner_volume"))
    whole = measures.volume(whole).select(KEY, F.col("signed_volume").alias("union_volume"))
    return _round(inner.join(whole, KEY), "inner_volume", "union_volume", digits=5)


@query(f"""WITH {TERRAIN} SELECT f.vids[1] AS fid, CASE WHEN f.vids[1] % 3 = 0 THEN 4 ELSE 3 END::BIGINT AS n_triangles,
    round(CASE WHEN f.vids[1] % 3 = 0 THEN 3.0 WHEN f.vids[1] % 3 = 1 THEN 2.377641 ELSE 3.0 END, 5) AS area FROM faces f WHERE f.fid % 2 = 0""")
def p16_ngons(spark, d):
    """A flat polygon for each cell of the terrain: an L of six corners, a regular pentagon, or an arrow of five."""
    cells = I.terrain(spark, d).faces.where(F.col("fid") % 2 == 0).select(F.col("vids")[0].alias("k"))
    ell = ((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    five = tuple((round(math.cos(math.tau * i / 5), 9), round(math.sin(math.tau * i / 5), 9)) for i in range(5))
    arrow = ((0, 0), (2, 0), (2, 2), (1, 1), (0, 2))
    shape = lambda corners: F.array(*[F.struct(F.lit(i).cast("long").alias("vid"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(corners)])
    kind = F.col("k") % 3
    shapes = cells.withColumn("s", F.when(kind == 0, shape(ell)).when(kind == 1, shape(five)).otherwise(shape(arrow)))
    points = shapes.select(F.col("k").alias(KEY), F.explode("s").alias("p")).select(KEY, "p.vid", "p.x", "p.y", (F.col("p.x") * 0.0).alias("z"))
    faces = shapes.select(F.col("k").alias(KEY), F.col("k").alias("fid"), F.col("s.vid").alias("vids"))
    three = triangulate.fat_triangles(Mesh(faces, points)).withColumn("a", P.area(F.col("pts")))
    return _round(three.groupBy("fid").agg(F.count("*").alias("n_triangles"), F.sum("a").alias("area")), "area", digits=5)
