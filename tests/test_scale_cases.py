"""Cases that small inputs hide: far queries, small meshes in a corpus, long walks, degenerate cuts."""

import math
import random

import numpy as np
import pytest
from meshes import mesh
from pyspark.sql import functions as F

from tessera.functions.facets import cut_face
from tessera.model import Mesh
from tessera.operators import cut, measures, paths, registration, spatial, topology
from tessera.sources import generate

POINT = "mesh_id long, vid long, x double, y double, z double"


def test_knn_of_far_queries_and_small_meshes(spark):
    rng = np.random.default_rng(1)
    p = [(0, i, *map(float, q)) for i, q in enumerate(rng.random((400, 3)))] + [(1, 7, 0.5, 0.5, 0.5), (1, 8, 0.6, 0.5, 0.5)]
    q = [(0, 0, 900.0, -500.0, 40.0), (0, 1, 0.5, 0.5, 0.5), (1, 2, 300.0, 0.0, 0.0), (2, 3, 0.0, 0.0, 0.0), (0, 4, 2.0, 2.0, 2.0)]
    got = {}
    for r in spatial.knn(spark.createDataFrame(p, POINT), spark.createDataFrame(q, POINT.replace("vid", "qid")), 5).orderBy("rank").collect():
        got.setdefault(r.qid, []).append(r.vid)
    for key, i, *at in q:
        own = sorted((sum((a - b) ** 2 for a, b in zip(at, x[2:], strict=True)), x[1]) for x in p if x[0] == key)[:5]
        assert got.get(i, []) == [v for _, v in own], i


def test_nearest_faces_without_a_radius(spark):
    m = generate.sphere(spark, 1.0, 8, 10)
    q = np.random.default_rng(2).normal(size=(15, 3)) * 4
    rows = spatial.nearest_faces(m, spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(q)], POINT.replace("vid", "qid"))).collect()
    assert sorted(r.qid for r in rows) == list(range(15))
    assert all(abs(math.sqrt(r.d2) - abs(np.linalg.norm(q[r.qid]) - 1)) < 0.12 for r in rows)
    near = spatial.nearest_faces(m, spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(q)], POINT.replace("vid", "qid")), 1.0).collect()
    assert {r.qid for r in near} == {r.qid for r in rows if r.d2 <= 1}


def test_boxes_of_every_mesh_are_fitted(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(12):
        p = rng.normal(size=(50, 3)) * [5, 2, 1]
        p[:, 0] += 0.2 * p[:, 1] ** 2
        rows += [(k, 1000 * k + i + 1, *map(float, x)) for i, x in enumerate(p)]
    a = spark.createDataFrame(rows, POINT)
    found = registration.fit_obb(a, a.withColumn("x", F.col("x") + 3)).collect()
    assert len(found) == 12 and all(np.allclose(np.reshape(r.m, (4, 4)), [[1, 0, 0, 3], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]], atol=1e-6) for r in found)


def test_eulerian_walks(spark):
    rng = random.Random(0)
    edges = [(0, i, rng.randrange(12), rng.randrange(12)) for i in range(60)] + [(1, 0, 5, 6), (1, 1, 6, 5), (1, 2, 6, 7), (1, 3, 7, 6), (2, 0, 1, 1)]
    edges += [(3, 2 * i + k, i if k else 0, 0 if k else i) for i in range(1, 15) for k in (0, 1)]  # circuits that share one vertex
    got = paths.eulerian_steps(spark.createDataFrame(edges, "mesh_id long, eid long, v0 long, v1 long")).collect()
    assert sorted((r.mesh_id, r.eid, r.v0, r.v1) for r in got) == sorted(edges)
    walks = {}
    for r in sorted(got, key=lambda r: r.pos):
        walks.setdefault((r.mesh_id, r.path_id), []).append(r)
    for w in walks.values():
        assert [r.pos for r in w] == list(range(len(w))) and all(a.v1 == b.v0 for a, b in zip(w, w[1:], strict=False))
        assert w[0].path_id == min(r.eid for r in w) or not w[0].closed or w[0].v0 == w[-1].v1
        assert w[0].closed == (w[0].v0 == w[-1].v1)
    for m in range(4):
        degree, up = {}, {}

        def top(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for k, _, a, b in edges:
            if k == m:
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) - 1 if a != b else degree.get(a, 0)
                up[top(a)] = top(b)
        need = {}
        for v, d in degree.items():
            need[top(v)] = need.get(top(v), 0) + max(d, 0)
        assert sum(k == m for k, _ in walks) == sum(max(1, n) for n in need.values())


def test_cut_faces_keep_their_area():
    rng = np.random.default_rng(4)
    for _ in range(60):
        c = rng.normal(size=(3, 3))
        at = lambda u, v, c=c: c[0] + u * (c[1] - c[0]) + v * (c[2] - c[0])
        line = [at(rng.uniform(0.1, 0.4), 0), *[at(0.15 + 0.05 * rng.random(), 0.1 + 0.15 * k + 0.05 * rng.random()) for k in range(4)], at(0, rng.uniform(0.75, 0.9))]
        loop = [at(0.5 + 0.08 * np.cos(x), 0.25 + 0.08 * np.sin(x)) for x in np.sort(rng.random(7)) * 2 * np.pi]
        segments = [(i, i + 1) for i in range(5)] + [(6 + i, 6 + (i + 1) % 7) for i in range(7)]
        points, triangles, regions = cut_face(c, np.array(line + loop), [segments[i] for i in rng.permutation(12)], 1e-9)
        normal = np.cross(c[1] - c[0], c[2] - c[0])
        areas = [np.cross(points[b] - points[a], points[d] - points[a]) @ normal / np.linalg.norm(normal) / 2 for a, b, d in triangles]
        assert min(areas) > 0 and sum(areas) == pytest.approx(np.linalg.norm(normal) / 2) and len(set(regions)) == 3


def _closed(m: Mesh, volume=None, rel=1e-9):
    kind = topology.closedness(m.faces).first()
    assert kind.is_closed and kind.is_manifold
    if volume is not None:
        assert measures.volume(m).first().signed_volume == pytest.approx(volume, rel=rel)


def _moved(m: Mesh, *by: float) -> Mesh:
    return Mesh(m.faces, m.points.withColumns({c: F.col(c) + d for c, d in zip("xyz", by, strict=True)}))


def test_booleans_are_closed(spark):
    s = generate.sphere(spark, 1, 10, 12)
    other = _moved(s, 0.5, 0.3, 0.2)
    ops = ("union", "intersection", "left_difference", "right_difference")
    found = [m for m, _ in cut.booleans(s, other, *ops)]
    for m in found:
        _closed(m)
    whole, inner, left, right = (measures.volume(m).first().signed_volume for m in found)
    one = measures.volume(s).first().signed_volume
    assert whole + inner == pytest.approx(2 * one) and left + inner == pytest.approx(one) and right == pytest.approx(left, rel=0.2)
    _closed(cut.embedded_curves(s, other)[0], one)


def test_degenerate_booleans_are_closed(spark):
    box = generate.box(spark, 2, 2, 2)
    _closed(cut.boolean(box, _moved(box, 2, 0.5, 0.5), "union")[0], 16)  # they touch in a plane
    (whole, _), (inner, _) = cut.booleans(box, _moved(box, 1, 0.5, 0), "union", "intersection")  # two planes in common
    _closed(whole, 13)
    _closed(inner, 3)
    n = 48
    c = generate.cylinder(spark, 1, 4, n)
    d = Mesh(c.faces, c.points.select("mesh_id", "vid", "x", (-F.col("z")).alias("y"), F.col("y").alias("z")))
    _closed(cut.boolean(c, d, "intersection")[0], 16 / 3, 0.01)  # every crossing is one of two edges


def test_neighborhoods_have_no_end(spark):
    n = 10
    points = [(k * 0.001, k % 2 * 0.001, 0) for k in range(n)]
    m = mesh(spark, points, [(k, k + 1, k + 2) for k in range(n - 2)])
    got = topology.neighborhoods(topology.vertex_link(m.faces), m.points, 1.0)
    assert got.count() == n * (n - 1)
