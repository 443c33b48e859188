"""Principal curvatures and directions by local quadratic fits, and the shape index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh
from tessera.operators.measures import point_normals
from tessera.operators.topology import k_rings, vertex_link


def principal_curvatures(mesh: Mesh, k: int = 2) -> DataFrame:
    """mesh_id, vid, k0, k1 (k0 >= k1), d0, d1 (directions).

    z = a x^2 + b x y + c y^2 + d x + e y is fitted to the k-ring in the frame of
    the vertex normal; the curvatures are the eigenvalues of [[2a, b], [b, 2c]].
    The rings are never gathered: the join that reaches them ends in the sums of
    the 5x5 equations. Fewer than five neighbours make zero.
    """
    ring = k_rings(vertex_link(mesh.faces), k).select(KEY, "vid", "neighbor")
    at = mesh.points.select(KEY, F.col("vid").alias("neighbor"), P.point().alias("q"))
    own = point_normals(mesh).join(mesh.points.select(KEY, "vid", P.point().alias("p")), [KEY, "vid"]).where("n IS NOT NULL")
    own = own.withColumn("b", P.basis(F.col("n")))
    d = P.sub(F.col("q"), F.col("p"))
    local = ring.join(at, [KEY, "neighbor"]).join(own, [KEY, "vid"]).select(KEY, "vid", "b", P.dot(d, F.col("b.u")).alias("x"), P.dot(d, F.col("b.v")).alias("y"), P.dot(d, F.col("n")).alias("z"))
    x, y = F.col("x"), F.col("y")
    terms = [x * x, x * y, y * y, x, y]
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(5) for j in range(i, 5)] + [F.sum(t * F.col("z")).alias(f"b{i}") for i, t in enumerate(terms)]
    frame = [F.first(f"b.{v}.{a}").alias(f"{v}{a}") for v in "uv" for a in P.AXES]
    eq = local.groupBy(KEY, "vid").agg(*sums, F.count("*").alias("n"), *frame)

    def run(parts):
        for t in parts:
            m = np.zeros((len(t), 5, 5))
            for i in range(5):
                for j in range(i, 5):
                    m[:, i, j] = m[:, j, i] = t[f"a{i}{j}"]
            b = np.stack([t[f"b{i}"] for i in range(5)], 1)
            s = (np.linalg.pinv(m, rcond=1e-12) @ b[:, :, None])[:, :, 0]
            s[t["n"].to_numpy() < 5] = 0
            h = np.stack([2 * s[:, 0], s[:, 1], s[:, 1], 2 * s[:, 2]], 1).reshape(-1, 2, 2)
            w, v = np.linalg.eigh(h)
            u = [np.stack([t[f"{c}{a}"] for a in P.AXES], 1) for c in "uv"]
            out = {KEY: t[KEY], "vid": t["vid"], "k0": w[:, 1], "k1": w[:, 0]}
            for k, col in (("d0", 1), ("d1", 0)):
                out[k] = list(v[:, 0, col, None] * u[0] + v[:, 1, col, None] * u[1])
            yield pd.DataFrame(out)

    return eq.mapInPandas(run, f"{KEY} long, vid long, k0 double, k1 double, d0 array<double>, d1 array<double>")


def shape_index(curvatures: DataFrame) -> DataFrame:
    """With shape_index from -1 to 1: 2 / pi * atan((k0 + k1) / (k0 - k1)); equal curvatures make 1, -1 or 0."""
    s, d = F.col("k0") + F.col("k1"), F.col("k0") - F.col("k1")
    return curvatures.withColumn("shape_index", F.when(F.abs(d) > 1e-12, 2 / math.pi * F.atan(s / d)).otherwise(F.signum(s)))
