"""Classes of near points where points are dense: no list of all pairs, the same classes."""

import random

from tessera.operators import clean, spatial


def _classes(points, t):
    up = {(m, v): (m, v) for m, v, *_ in points}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (m, v, *p) in enumerate(points):
        for n, w, *q in points[:i]:
            if m == n and sum((a - b) ** 2 for a, b in zip(p, q)) <= t * t:
                x, y = top((m, v)), top((n, w))
                up[max(x, y)] = min(x, y)
    return sorted((m, v, top((m, v))[1]) for m, v in up)


def test_dense_points_keep_their_classes(spark, monkeypatch):
    monkeypatch.setattr(spatial, "self_pairs_within", None)  # pairs are not listed here
    monkeypatch.setattr(spatial, "_DENSE", 0)
    rng = random.Random(1)
    points = []
    for m in (0, 7):
        for _ in range(9):  # crowds, some just within reach of each other and some just not, off their outermost points too
            c = [rng.uniform(-4, 4) for _ in range(3)]
            points += [(m, len(points) + k, *[x + rng.uniform(-0.55, 0.55) for x in c]) for k in range(12)]
    rng.shuffle(points)
    df = spark.createDataFrame(points, "mesh_id long, vid long, x double, y double, z double")
    assert sorted(tuple(r) for r in clean.point_map(df, 1.0).select("mesh_id", "old_id", "new_id").collect()) == _classes(points, 1.0)


def test_crowds_that_only_inner_points_connect(spark, monkeypatch):
    """Two crosses whose nearest points aren't outermost on any axis."""
    monkeypatch.setattr(spatial, "_DENSE", 0)
    a = [(0.0, 0.0, 0.0), (0.5, 0.1, 0.1), (0.1, 0.5, 0.1), (0.1, 0.1, 0.5), (0.32, 0.32, 0.32), (0.5, 0.0, 0.0), (0.0, 0.5, 0.0), (0.0, 0.0, 0.5)]
    b = [(1.7 - x, 1.7 - y, 1.7 - z) for x, y, z in a]
    for t, n in ((1.8, 2), (1.84, 1)):  # the inner ones are 1.836 apart
        points = [(0, i, *p) for i, p in enumerate(a + b)]
        df = spark.createDataFrame(points, "mesh_id long, vid long, x double, y double, z double")
        got = sorted(tuple(r) for r in clean.point_map(df, t).select("mesh_id", "old_id", "new_id").collect())
        assert got == _classes(points, t) and len({r[2] for r in got}) == n
