"""Exact meetings and closest points of triangles, segments and points, against slow searches."""

import itertools

import numpy as np
import pytest

from tessera.functions import contact as kernel
from tessera.model import Mesh
from tessera.operators import contact

FORM = "mesh_id long, id long, pts array<struct<x: double, y: double, z: double>>"


def shapes(rng, n):
    out = []
    for i in range(n):
        t = rng.integers(0, 5, (3, 3)).astype(float)
        t[1:] = t[:1] if i % 7 == 0 else t[1:]
        t[2] = t[1] if i % 3 == 0 else t[2]
        if i % 2:
            t[:, 2] = 1.0
        out.append(t)
    return np.array(out)


def sampled_distance(a, b, steps=24):
    """The least distance of dense samples, and so no less than the true one."""
    w = np.array([(i, j, steps - i - j) for i in range(steps + 1) for j in range(steps + 1 - i)]) / steps
    p, q = w @ a, w @ b
    return np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1).min())


def test_kernels_agree_with_samples_and_each_other():
    rng = np.random.default_rng(1)
    a, b = shapes(rng, 400), shapes(rng, 400)[rng.permutation(400)]
    d2, p, q = kernel.closest(a, b)
    met = kernel.meets(a, b)
    assert ((d2 < 1e-18) == met).all()
    for i in range(0, 400, 5):
        d = sampled_distance(a[i], b[i])
        assert np.sqrt(d2[i]) <= d + 1e-9 and d - np.sqrt(d2[i]) < 0.45
    assert np.allclose(((p - q) ** 2).sum(1), d2)
    for x, t in ((p, a), (q, b)):  # the points lie on their triangles
        spot = np.repeat(x[:, None], 3, 1)
        assert (kernel.closest(spot, t)[0] < 1e-16).all()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (((0, 0, 0), (4, 0, 0), (0, 4, 0)), ((1, 1, 0), (2, 1, 0), (1, 2, 0)), True),  # one inside the other, one plane
        (((0, 0, 0), (4, 0, 0), (0, 4, 0)), ((3, 3, 0), (5, 3, 0), (3, 5, 0)), False),
        (((0, 0, 0), (4, 0, 0), (0, 4, 0)), ((1, 1, -1), (1, 1, 1), (9, 9, 1)), True),  # pierced
        (((0, 0, 0), (4, 0, 0), (0, 4, 0)), ((0, 0, 1), (4, 0, 1), (0, 4, 1)), False),
        (((0, 0, 0), (2, 0, 0), (2, 0, 0)), ((2, 0, 0), (5, 0, 0), (5, 0, 0)), True),  # segments end to end
        (((0, 0, 0), (2, 0, 0), (2, 0, 0)), ((3, 0, 0), (5, 0, 0), (5, 0, 0)), False),
        (((0, 0, 0), (2, 2, 0), (2, 2, 0)), ((0, 2, 0), (2, 0, 0), (2, 0, 0)), True),
        (((1, 1, 0),) * 3, ((0, 0, 0), (4, 0, 0), (0, 4, 0)), True),
        (((1, 1, 0),) * 3, ((0, 0, 0), (2, 0, 0), (2, 0, 0)), False),
        (((1, 1, 1),) * 3, ((1, 1, 1),) * 3, True),
    ],
)
def test_known_meetings(a, b, want):
    assert kernel.meets(np.array([a], float), np.array([b], float))[0] == want
    assert (kernel.closest(np.array([a], float), np.array([b], float))[0][0] == 0) == want


def form(spark, triangles, mesh=0):
    return spark.createDataFrame([(mesh, i, [tuple(map(float, p)) for p in t]) for i, t in enumerate(triangles)], FORM)


def test_pairs_and_closest_members_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((60, 3, 3)) * 0.2 + rng.random((60, 1, 3)), rng.random((70, 3, 3)) * 0.2 + rng.random((70, 1, 3))
    far = b + np.array([2.0, 0.3, 0.0])
    pairs = np.array(list(itertools.product(range(60), range(70))))
    want = {tuple(p) for p in pairs[kernel.meets(a[pairs[:, 0]], b[pairs[:, 1]])].tolist()}
    fa, fb = form(spark, a), form(spark, b)
    assert {(r.id0, r.id1) for r in contact.gather_pairs(fa, fb).collect()} == want
    d2 = kernel.closest(a[pairs[:, 0]], b[pairs[:, 1]])[0]
    assert {(r.id0, r.id1) for r in contact.gather_pairs(fa, fb, 0.1).collect()} == {tuple(p) for p in pairs[d2 <= 0.01].tolist()}
    assert {r.id for r in contact.gather_ids(fa, fb).collect()} == {i for i, _ in want}
    two = fa.unionByName(form(spark, a, 1))
    other = form(spark, far).unionByName(form(spark, b, 1)).unionByName(form(spark, b, 2))
    got = {r.mesh_id: r for r in contact.closest_members(two, other).collect()}
    d2 = kernel.closest(a[pairs[:, 0]], far[pairs[:, 1]])[0]
    assert set(got) == {0, 1} and got[1].d2 == 0
    assert abs(got[0].d2 - d2.min()) < 1e-12 and (got[0].id0, got[0].id1) == tuple(pairs[d2.argmin()])
    assert {r.mesh_id for r in contact.forms_meet(two, other).collect()} == {1}
    assert contact.closest_members(two.limit(0), other).count() == 0


def test_forms_of_faces_edges_points_and_boxes(spark):
    points = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(itertools.product((0, 1), repeat=3))], "mesh_id long, vid long, x double, y double, z double")
    quad = Mesh(spark.createDataFrame([(0, 5, [0, 1, 3, 2])], "mesh_id long, fid long, vids array<long>"), points)
    edges = spark.createDataFrame([(0, 9, 4, 7)], "mesh_id long, eid long, v0 long, v1 long")
    box = spark.createDataFrame([(0, 1, (0.25, 0.25, 0.25), (3.0, 0.75, 0.75))], "mesh_id long, id long, low struct<x: double, y: double, z: double>, high struct<x: double, y: double, z: double>")
    faces = contact.of_faces(quad)
    assert [(r.id0, r.id1, r.d2) for r in contact.closest_members(faces, contact.of_edges(edges, points)).collect()] == [(5, 9, 1.0)]
    assert contact.form_distance(faces, contact.of_boxes(box)).first()["distance"] == 0.25
    assert sorted(r.id for r in contact.gather_ids(contact.of_points(points), faces).collect()) == [0, 1, 2, 3]
