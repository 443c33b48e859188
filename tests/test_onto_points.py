"""Rows meet their points by hash: no task sorts or holds a share of the rows, which are many times the points."""

from tessera.model import KEY, Mesh
from tessera.operators import measures


def _mesh(spark):
    points = spark.createDataFrame([(m, v, float(v), float(v * v), float(m)) for m in range(3) for v in range(6)], f"{KEY} long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(m, f, [f % 6, (f + 1) % 6, (f + m) % 7]) for m in range(3) for f in range(12)], f"{KEY} long, fid long, vids array<long>")
    return Mesh(faces, points)


def test_rows_are_not_sorted_for_their_points(spark):
    plan = measures.edge_lengths(_mesh(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and "Broadcast" not in plan


def test_same_lengths_with_missing_points(spark):
    m = _mesh(spark)
    got = {r[KEY]: (r.mean_edge, r.min_edge, r.max_edge) for r in measures.edge_lengths(m).collect()}
    for k in range(3):
        sides = [(v[i], v[(i + 1) % 3]) for f in range(12) for v in [[f % 6, (f + 1) % 6, (f + k) % 7]] for i in range(3)]
        found = [((a - b) ** 2 + (a * a - b * b) ** 2) ** 0.5 for a, b in sides if max(a, b) < 6]
        mean, low, high = got[k]
        assert abs(mean - sum(found) / len(found)) < 1e-9 and abs(low - min(found)) < 1e-12 and abs(high - max(found)) < 1e-12
