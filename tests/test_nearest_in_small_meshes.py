"""Nearest faces of small meshes need no search for near vertices."""

from meshes import HOUSE, OCTA, mesh

from tessera.model import Mesh
from tessera.operators import spatial


def test_small_meshes_need_no_search(spark, monkeypatch):
    monkeypatch.setattr(spatial, "knn", None)
    a, b = mesh(spark, *HOUSE), mesh(spark, *OCTA, key=1)
    m = Mesh(a.faces.unionByName(b.faces), a.points.unionByName(b.points))
    q = spark.createDataFrame([(0, 0, 2.0, 0.5, 2.0), (0, 1, -3.0, 0.0, 0.0), (1, 0, 2.0, 0.0, 0.0), (5, 0, 0.0, 0.0, 0.0)], "mesh_id long, qid long, x double, y double, z double")
    rows = sorted((r.mesh_id, r.qid, r.fid, round(r.d2, 9)) for r in spatial.nearest_faces(m, q).collect())
    assert rows == [(0, 0, 0, 4.0), (0, 1, 0, 9.0), (1, 0, 0, 1.0)]
