"""Pieces of faces are cut once, however often they are read."""

import meshes as M
from pyspark.sql import functions as F

from tessera.model import Mesh
from tessera.operators import contours, cut, spatial


def test_bands_are_not_cut_anew_for_each_reader(spark):
    m = M.mesh(spark, *M.HOUSE)
    split, labels = contours.embedded_isocurves(Mesh(m.faces, m.points.withColumn("scalar", F.col("x") + F.col("y") / 3)), [0.5, 2.0])
    for t in (split.faces, split.points, labels):
        assert "MapInPandas" not in t._jdf.queryExecution().executedPlan().toString()
    assert {r.band for r in labels.collect()} == {0, 1, 2} and split.faces.count() == labels.count()


def test_cut_faces_are_not_cut_anew_for_their_ids(spark, monkeypatch):
    plans, whole = [], cut.dense_ids

    def seen(rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return whole(rows, *args)

    monkeypatch.setattr(cut, "dense_ids", seen)
    m = M.mesh(spark, *M.OCTA)
    moved = Mesh(m.faces, m.points.withColumns({"x": F.col("x") + 0.31, "y": F.col("y") + 0.17}))
    split, labels = cut.embedded_curves(m, moved)
    assert plans and "MapInPandas" not in plans[0]
    assert split.faces.count() == labels.count() > 8


def test_small_meshes_need_no_search(spark, monkeypatch):
    rows = [(m, v, float(v * 7 % 11), float(v * 5 % 13), float((v + m) * 3 % 7)) for m in range(4) for v in range(20 + 30 * (m == 3))]
    points = spark.createDataFrame(rows, "mesh_id long, vid long, x double, y double, z double")
    queries = points.where("vid < 9").withColumnRenamed("vid", "qid").withColumn("x", F.col("x") + 0.4)
    want = {}
    for m, q, x, y, z in rows:
        if q < 9:
            d = sorted(((a - x - 0.4) ** 2 + (b - y) ** 2 + (c - z) ** 2, v) for n, v, a, b, c in rows if n == m)
            want[m, q] = d
    searched = []
    whole = spatial._knn
    monkeypatch.setattr(spatial, "_knn", lambda p, *a: searched.append({r[0] for r in p.select("mesh_id").distinct().collect()}) or whole(p, *a))
    for few, left in ((64, []), (30, [{3}])):
        monkeypatch.setattr(spatial, "_FEW", few)
        for k, radius in ((1, None), (3, None), (3, 2.0)):
            searched.clear()
            got = {}
            for r in spatial.knn(points, queries, k, radius).collect():
                got.setdefault((r.mesh_id, r.qid), {})[r["rank"]] = r.vid
            near = {key: {i + 1: v for i, (d2, v) in enumerate(d[:k]) if radius is None or d2 <= radius * radius} for key, d in want.items()}
            assert got == {key: v for key, v in near.items() if v}
            assert searched == left
