"""Iterated alignment of many meshes at once, and an index whose touched partitions alone are rewritten."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.operators import registration, spatial
from tessera.streaming import incremental

POINT = "mesh_id long, vid long, x double, y double, z double"


def test_every_mesh_has_its_own_motion(spark):
    rng = np.random.default_rng(4)
    source, target, want = [], [], {}
    for mesh in range(4):
        p = rng.random((80, 3)) * 10
        m = np.reshape(P.compose(P.translation(0.02 * mesh, 0.01 * mesh, 0), P.rotation((0, 0, 1), 0.004 * mesh)), (4, 4))
        want[mesh] = m
        source += [(mesh, i, *x) for i, x in enumerate(p.tolist())]
        target += [(mesh, i + 1000, *x) for i, x in enumerate((p @ m[:3, :3].T + m[:3, 3]).tolist())]
    source.append((9, 1, 0.0, 0.0, 0.0))  # a mesh without a target
    a, b = spark.createDataFrame(source, POINT), spark.createDataFrame(target, POINT)
    got = {r.mesh_id: r for r in registration.fit_icp(a, b, rounds=4).collect()}
    assert set(got) == {0, 1, 2, 3}
    for mesh, m in want.items():
        assert np.allclose(np.reshape(got[mesh].m, (4, 4)), m, atol=1e-6)
    assert got[0].rounds == 2 and got[0].error < 1e-12 and got[3].rounds == 4
    n = np.random.default_rng(1).normal(size=(len(target), 3))
    normals = spark.createDataFrame([(t[0], t[1], *map(float, x)) for t, x in zip(target, n / np.linalg.norm(n, axis=1)[:, None], strict=True)], POINT)
    plane = registration.fit_icp(a, b, rounds=4, normals=normals.select("mesh_id", "vid", P.point().alias("n"))).collect()
    assert all(np.allclose(np.reshape(r.m, (4, 4)), want[r.mesh_id], atol=1e-4) for r in plane) and len(plane) == 4


def test_a_sample_is_the_smallest_hashes(spark):
    points = spark.range(5000).select(F.lit(0).cast("long").alias("mesh_id"), F.col("id").alias("vid"), *[F.lit(0.0).alias(a) for a in "xyz"])
    got = {r.vid for r in registration.sampled(points, 50, 3).collect()}
    assert got == {r.vid for r in points.orderBy(F.xxhash64("vid", F.lit(3))).limit(50).collect()}
    assert registration.sampled(points.limit(7), 50).count() == 7


def test_touched_partitions_alone_are_rewritten(spark, tmp_path):
    rng = random.Random(2)
    points = [(m, i, rng.random() * 100, rng.random() * 100, rng.random() * 100) for m in range(3) for i in range(300)]
    path = str(tmp_path / "index")
    incremental.write_index(spatial.point_boxes(spark.createDataFrame(points, POINT)), path, 2.0, 25.0, 64)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    at = {(m, i): p for m, i, *p in points}
    moved = {(0, 5): [1.0, 1.0, 1.0], (1, 7): [99.0, 2.0, 3.0]}
    batch = spatial.point_boxes(spark.createDataFrame([(*k, *v) for k, v in moved.items()] + [(2, 9, 0.0, 0.0, 0.0)], POINT))
    batch = batch.withColumns({"removed": F.col("mesh_id") == 2, "seq": F.lit(1)})
    apply = incremental.partition_updater(spark, path, 2.0, 25.0, 64)
    for _ in range(2):  # a batch may run again
        apply(batch, 0)
    at = {k: v for k, v in (at | moved).items() if k != (2, 9)}
    got = {(r.mesh_id, r.id): (r.cx, r.cy, r.cz) for r in spark.read.parquet(path).collect()}
    assert got == {k: tuple(int(c // 2) for c in v) for k, v in at.items()}
    assert len(before - files()) <= 6 < len(before) / 4
