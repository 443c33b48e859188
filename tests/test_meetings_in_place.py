"""Pairs are made where their members meet: no table of pairs goes through a shuffle."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.model import Mesh
from tessera.operators import cut, spatial

POINT = "mesh_id long, vid long, x double, y double, z double"


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pairs_within_are_all_found_in_one_join(spark):
    rng = random.Random(5)
    rows = [(k % 2, k, *[rng.choice((-1, 1)) * rng.randrange(9) / 2 for _ in "xyz"]) for k in range(200)]
    points = spark.createDataFrame(rows, POINT)
    d2 = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[2:], q[2:], strict=True))
    for distance in (0.0, 0.5, 1.0, 1.7):
        want = {(p[0], p[1], q[1]) for p, q in itertools.product(rows, rows) if p[0] == q[0] and d2(p, q) <= distance * distance}
        both = spatial.pairs_within(points, points, distance)
        assert _exchanges(both) == 2
        got = [(r.mesh_id, r.id0, r.id1) for r in both.collect()]
        assert len(got) == len(want) and set(got) == want
        own = spatial.self_pairs_within(points, distance)
        assert _exchanges(own) == 2
        got = [(r.mesh_id, r.id0, r.id1) for r in own.collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if w[1] < w[2]}


def test_triangles_that_meet_bring_their_points(spark):
    points = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 2.0, 0.0, 0.0), (0, 2, 0.0, 2.0, 0.0), (0, 3, 0.5, 0.5, -1.0), (0, 4, 0.5, 0.5, 1.0), (0, 5, 3.0, 3.0, 1.0)], POINT)
    faces = spark.createDataFrame([(0, 0, [0, 1, 2]), (0, 1, [3, 4, 5])], "mesh_id long, fid long, vids array<long>")
    f = cut._facets(Mesh(faces, points))
    met = cut._self_met(f)
    assert _exchanges(met) == 2
    assert [(r.id0.src, r.id1.src) for r in met.collect()] == [(0, 1)]


def test_boxes_of_many_sizes_lie_on_one_level_where_there_is_room(spark):
    rows = [(0, k, float(3 * k), 2.0**-k) for k in range(8)]
    b = spark.createDataFrame(rows, "mesh_id long, id long, at double, w double")
    corner = lambda v: F.struct(v.alias("x"), v.alias("y"), v.alias("z"))
    b = b.select("mesh_id", "id", corner(F.col("at")).alias("low"), corner(F.col("at") + F.col("w")).alias("high"))
    met = spatial.cell_meetings(b, b)
    assert {(r.id0, r.id1) for r in spatial.box_pairs(b, b).collect()} == {(k, k) for k in range(8)}
    assert met.select("level").distinct().count() == 1
