"""Ids of pieces and triangles stay apart however many a face has."""

import math

from tessera.model import Mesh
from tessera.operators import cut, triangulate


def test_pieces_beyond_4096(spark):
    corner = "array<struct<x: double, y: double, z: double>>"
    tri = lambda k: [(float(k), 0.0, 0.0), (k + 1.0, 0.0, 0.0), (float(k), 1.0, 0.0)]
    rows = [(0, 1, 0, tri(0), 0), (0, 1, 4096, tri(2), 0), (0, 2, 0, tri(4), 0)]
    pieces = spark.createDataFrame(rows, f"mesh_id long, src_fid long, piece int, pts {corner}, origin int")
    mesh, labels = cut._indexed(pieces.drop("origin"))
    assert sorted(r.src_fid for r in labels.select("fid", "src_fid").distinct().collect()) == [1, 1, 2]
    assert [len(r.vids) for r in mesh.faces.collect()] == [3, 3, 3]
    assert cut._named(pieces).select("fid").distinct().count() == 3
    assert sorted(r.fid for r in cut._indexed(pieces.drop("origin"))[1].collect()) == [0, 1, 2]


def test_polygons_of_more_triangles_than_the_stride(spark):
    points = [(0, k, math.cos(k), math.sin(k), 0.0) for k in range(6)]
    faces = [(0, 0, list(range(6))), (0, 1, list(range(6)))]
    mesh = Mesh(spark.createDataFrame(faces, "mesh_id long, fid long, vids array<long>"), spark.createDataFrame(points, "mesh_id long, vid long, x double, y double, z double"))
    assert triangulate.triangulated(mesh, stride=2).select("fid").distinct().count() == 8


def test_mesh_ids_beyond_53_bits(spark):
    def mesh(shift):
        points = [(m, k, x + shift, y, 0.5 * shift * k) for m in ids for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])]
        faces = [(m, 0, [0, 1, 2]) for m in ids]
        return Mesh(spark.createDataFrame(faces, "mesh_id long, fid long, vids array<long>"), spark.createDataFrame(points, "mesh_id long, vid long, x double, y double, z double"))

    ids = [-3, 2**60 + 1]
    got = cut.arrangement(mesh(0.0), mesh(5.0)).select("mesh_id", "origin").collect()
    assert sorted((r.mesh_id, r.origin) for r in got) == [(m, o) for m in ids for o in (0, 1)]
