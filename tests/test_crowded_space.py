"""Clusters, outliers and boxes of very different sizes: results against plain Python, and how many pairs are met."""

import random

from pyspark.sql import functions as F

from tessera.operators import spatial

POINT = "mesh_id long, vid long, x double, y double, z double"


def cloud(rng, n, spread):
    return [tuple(rng.random() * s for s in spread) for _ in range(n)]


def nearest(points, q, k):
    return sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), i) for i, p in enumerate(points))[:k]


def test_knn_of_clusters_and_outliers(spark):
    rng = random.Random(3)
    points = cloud(rng, 600, (1.0, 1.0, 1.0)) + [tuple(5e5 + x for x in p) for p in cloud(rng, 300, (1e-3, 1e-3, 1e-3))] + [(1e6, 1e6, -1e6)] + [(7.0, 7.0, 7.0)] * 200
    queries = cloud(rng, 60, (1.0, 1.0, 1.0)) + [tuple(5e5 + x for x in p) for p in cloud(rng, 30, (1e-3, 1e-3, 1e-3))] + [(9e5, 0.0, 0.0), (7.0, 7.0, 7.0), (7.5, 7.0, 7.0)]
    named = spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)], POINT)
    asked = spark.createDataFrame([(0, i, *q) for i, q in enumerate(queries)], POINT.replace("vid", "qid"))
    got = {}
    for r in spatial.knn(named, asked, 3).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.vid, r.d2))
    for i, q in enumerate(queries):
        want = nearest(points, q, 3)
        assert [v for _, v, _ in sorted(got[i])] == [v for _, v in want], (i, q)


def test_an_outlier_changes_how_many_points_are_met_by_little(spark, monkeypatch):
    rng = random.Random(4)
    points = cloud(rng, 3000, (10.0, 10.0, 10.0))
    queries = spark.createDataFrame([(0, i, *q) for i, q in enumerate(cloud(rng, 300, (10.0, 10.0, 10.0)))], POINT.replace("vid", "qid"))
    met, whole = [], spatial._meetings

    def counted(*args):
        out = spark.createDataFrame((found := whole(*args)).collect(), found.schema)
        met.append(out.count())
        return out

    monkeypatch.setattr(spatial, "_meetings", counted)
    totals = []
    for extra in ([], [(1e6, 1e6, 1e6)]):
        met.clear()
        spatial.knn(spark.createDataFrame([(0, i, *p) for i, p in enumerate(points + extra)], POINT), queries, 4).count()
        totals.append(sum(met))
    assert totals[1] < 4 * totals[0] and totals[1] < 300 * 3000 / 8


BOX = "mesh_id long, id long, low struct<x: double, y: double, z: double>, high struct<x: double, y: double, z: double>"


def boxes(spark, rows):
    return spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(rows)], BOX)


def test_boxes_of_very_different_sizes(spark):
    rng = random.Random(5)
    small = [(p, tuple(x + rng.choice([0.0, 0.01, 0.05]) for x in p)) for p in cloud(rng, 1500, (2.0, 2.0, 2.0))]
    huge = [((1e3 * i, 0.0, 0.0), (1e3 * i + 900.0, 900.0, 900.0)) for i in range(1, 9)] + [((-1.0, -1.0, -1.0), (1.0, 1.0, 1.0))]
    rows = small + huge
    b = boxes(spark, rows)
    got = {(r.id0, r.id1) for r in spatial.box_pairs(b, b).where("id0 < id1").collect()}
    want = {(i, j) for i, (a, b) in enumerate(rows) for j, (c, d) in enumerate(rows[i + 1 :], i + 1) if all(a[k] <= d[k] and c[k] <= b[k] for k in range(3))}
    assert got == want
    alone, beside = (spatial.cell_meetings(x, x).where(F.col("id0") < F.col("id1")).count() for x in (boxes(spark, small), b))
    assert alone < 60_000 and beside < alone + 20 * len(small)


def test_points_alone_meet_where_they_are_equal(spark):
    p = spatial.point_boxes(spark.createDataFrame([(0, 1, 1.5, 2.0, 3.0), (0, 2, 1.5, 2.0, 3.0), (0, 3, 1.5, 2.0, 3.5)], POINT))
    assert {(r.id0, r.id1) for r in spatial.box_pairs(p, p).where("id0 < id1").collect()} == {(1, 2)}
    assert spatial.box_pairs(p.limit(0), p).count() == 0
