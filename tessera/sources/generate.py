"""Meshes by arithmetic on ranges of ids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh


def _points(rows: DataFrame, x, y, z) -> DataFrame:
    c = [v if not isinstance(v, (int, float)) else F.lit(float(v)) for v in (x, y, z)]
    return rows.select(F.lit(0).cast("long").alias(KEY), F.col("id").alias("vid"), *[v.cast("double").alias(a) for v, a in zip(c, P.AXES, strict=True)])


def _faces(rows: DataFrame, *faces) -> DataFrame:
    """Each row's faces, numbered in turn."""
    n = len(faces)
    return rows.select(F.lit(0).cast("long").alias(KEY), F.posexplode(F.array(*[F.array(*[v.cast("long") for v in f]) for f in faces])).alias("k", "vids"), F.col("id").alias("_i")).select(KEY, (F.col("_i") * n + F.col("k")).alias("fid"), "vids")


def plane(spark: SparkSession, width: float, height: float, nx: int = 1, ny: int = 1) -> Mesh:
    """A grid of nx by ny cells about the origin, two triangles each."""
    i = F.col("id")
    w = nx + 1
    col, row = i % w, F.floor(i / w)
    points = _points(spark.range(w * (ny + 1)), col * (width / nx) - width / 2, row * (height / ny) - height / 2, 0)
    v = F.floor(i / nx) * w + i % nx
    return Mesh(_faces(spark.range(nx * ny), (v, v + 1, v + w), (v + 1, v + w + 1, v + w)), points)


def sphere(spark: SparkSession, radius: float, stacks: int, segments: int) -> Mesh:
    """2 + (stacks - 1) * segments points; faces point outwards."""
    i = F.col("id")
    s, n = segments, 2 + (stacks - 1) * segments
    ring, k = F.floor((i - 1) / s) + 1, (i - 1) % s
    a, b = ring * (math.pi / stacks), k * (2 * math.pi / s)
    pole = (i == 0) | (i == n - 1)
    x = F.when(pole, 0.0).otherwise(F.sin(a) * F.cos(b) * radius)
    y = F.when(pole, 0.0).otherwise(F.sin(a) * F.sin(b) * radius)
    z = F.when(i == 0, float(radius)).when(i == n - 1, -float(radius)).otherwise(F.cos(a) * radius)
    points = _points(spark.range(n), x, y, z)
    j, m = i % s, F.floor(i / s)
    here, side = 1 + m * s + j, 1 + m * s + (j + 1) % s
    caps = _faces(spark.range(s), (F.lit(0), 1 + i, 1 + (i + 1) % s), (F.lit(n - 1), n - 1 - s + (i + 1) % s, n - 1 - s + i))
    body = _faces(spark.range((stacks - 2) * s), (here, here + s, side), (side, here + s, side + s))
    return Mesh(caps.unionByName(body.withColumn("fid", F.col("fid") + 2 * s)), points)


def box(spark: SparkSession, width: float, height: float, depth: float) -> Mesh:
    """Eight points, twelve triangles that point outwards."""
    i = F.col("id")
    sign = lambda k: (F.shiftright(i, k) % 2) - 0.5
    points = _points(spark.range(8), sign(0) * width, sign(1) * height, sign(2) * depth)
    #: The two triangles of each side, by corner number (bit 0 x, bit 1 y, bit 2 z).
    quads = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))
    tri = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    return Mesh(_faces(spark.range(1), *[[F.lit(v) for v in t] for t in tri]), points)


def box_grid(spark: SparkSession, width: float, height: float, depth: float, ticks: int) -> Mesh:
    """A box of ticks by ticks cells on each side; points on its edges are shared."""
    from tessera.operators.clean import clean_faces
    from tessera.operators.reindex import concatenated

    quarter = math.pi / 2
    sides = (
        (width, height, depth, None), (width, height, depth, ((1, 0, 0), 2 * quarter)),
        (width, depth, height, ((1, 0, 0), quarter)), (width, depth, height, ((1, 0, 0), -quarter)),
        (depth, height, width, ((0, 1, 0), quarter)), (depth, height, width, ((0, 1, 0), -quarter)),
    )
    made = [plane(spark, a, b, ticks, ticks) for a, b, _, _ in sides]
    moves = [P.compose(P.rotation(*turn) if turn else P.translation(0, 0, 0), P.translation(0, 0, out / 2)) for _, _, out, turn in sides]
    m = concatenated(*made, transforms=moves)
    near = m.points.withColumns({a: F.round(a, 9) + 0.0 for a in P.AXES})
    return clean_faces(Mesh(m.faces, near)).mesh


def cylinder(spark: SparkSession, radius: float, height: float, segments: int) -> Mesh:
    """Capped, along z, 2 * segments + 2 points; faces point outwards."""
    i = F.col("id")
    s = segments
    low, k = F.floor(i / s) == 0, i % s
    middle = i >= 2 * s
    a = k * (2 * math.pi / s)
    x = F.when(middle, 0.0).otherwise(F.cos(a) * radius)
    y = F.when(middle, 0.0).otherwise(F.sin(a) * radius)
    z = F.when(low | (i == 2 * s), -height / 2).otherwise(height / 2)
    points = _points(spark.range(2 * s + 2), x, y, z)
    nxt = (i + 1) % s
    faces = _faces(spark.range(s), (i, nxt, i + s), (nxt, nxt + s, i + s), (F.lit(2 * s), nxt, i), (F.lit(2 * s + 1), i + s, nxt + s))
    return Mesh(faces, points)
