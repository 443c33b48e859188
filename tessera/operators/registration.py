"""Alignment of point sets: rigid, similarity, point-to-plane, box, nearest-neighbour and iterated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions import primitives as P
from tessera.model import KEY
from tessera.operators.measures import cross_covariance, obb
from tessera.operators.spatial import knn
from tessera.sources.scratch import table

AXES = P.AXES
MATRIX = f"{KEY} long, m array<double>"


def _solve(stats: DataFrame, similarity: bool = False) -> DataFrame:
    """From one row of sums for each mesh_id to its matrix."""

    def run(parts):
        for t in parts:
            out = []
            for r in t.itertuples(index=False):
                h = np.array([[getattr(r, f"h{a}{b}") for b in AXES] for a in AXES])
                x, y = np.array([getattr(r, f"l{a}") for a in AXES]), np.array([getattr(r, f"r{a}") for a in AXES])
                scale = kernels.rotation_stretch(h) / r.spread if similarity and r.spread > 0 else 1.0
                out.append(kernels.rigid(h, x, y, scale).ravel())
            yield pd.DataFrame({KEY: t[KEY], "m": out})

    return stats.mapInPandas(run, MATRIX)


def fit_rigid(source: DataFrame, target: DataFrame, on: str = "vid") -> DataFrame:
    """(mesh_id, m): the rigid motion of paired points with the least squares error."""
    return _solve(cross_covariance(source, target, on))


def fit_similarity(source: DataFrame, target: DataFrame, on: str = "vid") -> DataFrame:
    """With a uniform scale; covariance and spread are both divided by n."""
    return _solve(cross_covariance(source, target, on), similarity=True)


def fit_point_to_plane(pairs: DataFrame) -> DataFrame:
    """(mesh_id, m) from rows with structs p (source), q (target), n (target normal) and a weight w, linearised about the source's place.

    The 6x6 normal equations are 27 sums, so the pairs never meet in one place.
    """
    c = P.cross(F.col("p"), F.col("n"))
    row = [c[a] for a in AXES] + [F.col("n")[a] for a in AXES]
    off = P.dot(F.col("n"), P.sub(F.col("q"), F.col("p")))
    sums = [F.sum(F.col("w") * row[i] * row[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)] + [F.sum(F.col("w") * row[i] * off).alias(f"b{i}") for i in range(6)]

    def run(parts):
        for t in parts:
            out = []
            for r in t.itertuples(index=False):
                a = np.array([[getattr(r, f"a{min(i, j)}{max(i, j)}") for j in range(6)] for i in range(6)])
                x = np.linalg.lstsq(a, np.array([getattr(r, f"b{i}") for i in range(6)]), rcond=None)[0]
                out.append(kernels.small_rotation(x[:3], x[3:]).ravel())
            yield pd.DataFrame({KEY: t[KEY], "m": out})

    return pairs.groupBy(KEY).agg(*sums).mapInPandas(run, MATRIX)


def transformed(points: DataFrame, matrices: DataFrame) -> DataFrame:
    """points moved by the matrix of their mesh_id."""
    moved = points.join(matrices, KEY).withColumn("_p", P.transform_point(P.point(), F.col("m")))
    return moved.withColumns({a: F.col("_p")[a] for a in AXES}).select(*points.columns)


def sampled(points: DataFrame, most: int, turn: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """The most points of each mesh, or all of fewer, with the smallest hashes of vid and turn, numbered from 0 on as _n.

    counts (mesh_id, n), where known: points with hashes far above a mesh's
    share are left out before the ranking, so that no task sorts a whole mesh.
    """
    h = F.xxhash64("vid", F.lit(turn))
    counts = points.groupBy(KEY).agg(F.count("*").alias("n")) if counts is None else counts
    share = (4.0 * most + 100) / F.col("_total")
    few = points.join(counts.select(KEY, F.col("n").alias("_total")), KEY).where(h / float(1 << 64) + 0.5 <= share).select(*points.columns)
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(h, "vid"))
    return few.withColumn("_n", rank).where(F.col("_n") <= most).withColumn("_n", F.col("_n") - 1)


def fit_obb(source: DataFrame, target: DataFrame, sample: int = 100) -> DataFrame:
    """(mesh_id, m): box onto box; of the four turns that fit, the one with the least summed squared distance of a sample of the source."""

    def run(parts):
        for t in parts:
            rows = []
            for r in t.itertuples(index=False):
                a, b = np.reshape(r.a, (3, 3)), np.reshape(r.b, (3, 3))
                ca = np.array([r.ox, r.oy, r.oz]) + (np.array([r.e0, r.e1, r.e2]) / 2) @ a
                cb = np.array([r.px, r.py, r.pz]) + (np.array([r.f0, r.f1, r.f2]) / 2) @ b
                for k, s in enumerate(([1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1])):
                    m = np.eye(4)
                    m[:3, :3] = b.T @ np.diag(s) @ a
                    m[:3, 3] = cb - m[:3, :3] @ ca
                    rows.append((getattr(r, KEY), k, m.ravel()))
            yield pd.DataFrame(rows, columns=[KEY, "k", "m"])

    s = obb(source).withColumnRenamed("axes", "a")
    t = obb(target).select(KEY, F.col("axes").alias("b"), *[F.col(f"o{a}").alias(f"p{a}") for a in AXES], *[F.col(f"e{k}").alias(f"f{k}") for k in range(3)])
    four = table(s.join(t, KEY).mapInPandas(run, f"{KEY} long, k int, m array<double>"))
    tried = sampled(source, sample).join(four, KEY).withColumn("_p", P.transform_point(P.point(), F.col("m")))
    probes = tried.select(KEY, (F.col("_n") * 4 + F.col("k")).cast("long").alias("qid"), *[F.col("_p")[a].alias(a) for a in AXES])
    error = knn(target, probes, 1).groupBy(KEY, F.pmod("qid", F.lit(4)).cast("int").alias("k")).agg(F.sum("d2").alias("e"))
    best = error.groupBy(KEY).agg(F.min(F.struct("e", "k")).alias("b")).select(KEY, F.col("b.k").alias("k"))
    return four.join(best, [KEY, "k"]).select(KEY, "m")


def soft_targets(source: DataFrame, target: DataFrame, k: int = 1, sigma: float = -1.0, outlier: float = 0.0) -> DataFrame:
    """(mesh_id, vid, x, y, z, d2): for each source point the Gaussian-weighted mean of its k nearest targets.

    sigma below zero: the distance to the k-th. outlier: the share of source
    points with the largest nearest distance that is left out.
    """
    near = knn(target, source.withColumnRenamed("vid", "qid"), k)
    near = near.join(target.select(KEY, "vid", *AXES), [KEY, "vid"])
    if sigma > 0:
        w = F.exp(-F.col("d2") / (2 * sigma * sigma))
    else:
        far = near.groupBy(KEY, "qid").agg(F.max("d2").alias("_f"))
        near = near.join(far, [KEY, "qid"])
        w = F.when(F.col("_f") > 0, F.exp(-F.col("d2") / (2 * F.col("_f")))).otherwise(1.0)
    soft = near.withColumn("_w", w).groupBy(KEY, "qid").agg(*[(F.sum(F.col("_w") * F.col(a)) / F.sum("_w")).alias(a) for a in AXES], F.min("d2").alias("d2"))
    if outlier > 0:
        cut = soft.groupBy(KEY).agg(F.percentile("d2", F.lit(1 - outlier)).alias("_c"))
        soft = soft.join(cut, KEY).where("d2 <= _c").drop("_c")
    return soft.withColumnRenamed("qid", "vid")


def fit_knn(source: DataFrame, target: DataFrame, k: int = 1, sigma: float = -1.0, outlier: float = 0.0) -> DataFrame:
    """One alignment step: (mesh_id, m) onto soft targets."""
    return fit_rigid(source, table(soft_targets(source, target, k, sigma, outlier)))


def _product(a: str, b: str) -> Column:
    """The row-major product of two 4x4 matrix columns."""
    entry = lambda m, r, c: F.get(m, F.lit(4 * r + c))
    return F.array(*[sum((entry(a, r, k) * entry(b, k, c) for k in range(1, 4)), entry(a, r, 0) * entry(b, 0, c)) for r in range(4) for c in range(4)])


def _plane_steps(moved: DataFrame, target: DataFrame, normals: DataFrame, outlier: float) -> tuple[DataFrame, DataFrame]:
    """Point-to-plane steps and errors of points against the planes at their nearest targets."""
    near = knn(target, moved.withColumnRenamed("vid", "qid"), 1)
    if outlier > 0:
        near = near.join(near.groupBy(KEY).agg(F.percentile("d2", F.lit(1 - outlier)).alias("_c")), KEY).where("d2 <= _c").drop("_c")
    at = target.select(KEY, "vid", P.point().alias("q")).join(normals.select(KEY, "vid", "n"), [KEY, "vid"])
    pairs = table(near.join(at, [KEY, "vid"]).join(moved.select(KEY, F.col("vid").alias("qid"), P.point().alias("p")), [KEY, "qid"]))
    return fit_point_to_plane(pairs.withColumn("w", F.lit(1.0))), pairs.groupBy(KEY).agg(F.avg(F.sqrt("d2")).alias("error"))


def fit_icp(source: DataFrame, target: DataFrame, rounds: int = 30, samples: int = 1000, k: int = 1, outlier: float = 0.0, tolerance: float = 1e-4, smooth: float = 0.3, normals: DataFrame | None = None) -> DataFrame:
    """(mesh_id, m, rounds, error): for each mesh_id that both sets have, the matrix that iterated alignment ends with.

    Every round moves a bounded sample of the source; the target stays where it
    is. A mesh ends when its own smoothed mean distance no longer falls, and
    only meshes that go on are met again. With normals (mesh_id, vid, n) of the
    target, steps go to the planes at the nearest points.
    """
    source, target = table(source), table(target)
    counts = table(source.groupBy(KEY).agg(F.count("*").alias("n")))
    both = counts.join(target.select(KEY).distinct(), KEY, "left_semi")
    start = F.array(*[F.lit(float(i % 5 == 0)) for i in range(16)])
    none = F.lit(None).cast("double")
    live = table(both.select(KEY, start.alias("m"), none.alias("mean"), F.lit(0).alias("rounds")))
    ended = live.limit(0)
    for i in range(rounds):
        if live.isEmpty():
            break
        going = live.select(KEY)
        part = sampled(source.join(going, KEY, "left_semi"), samples, i, counts)
        moved = table(transformed(part.select(KEY, "vid", *AXES), live.select(KEY, "m")))
        goal = target.join(going, KEY, "left_semi")
        if normals is None:
            soft = table(soft_targets(moved, goal, k, -1.0, outlier))
            steps, errors = fit_rigid(moved, soft), soft.groupBy(KEY).agg(F.avg(F.sqrt("d2")).alias("error"))
        else:
            steps, errors = _plane_steps(moved, goal, normals, outlier)
        met = live.join(steps.withColumnRenamed("m", "step"), KEY, "left").join(errors, KEY, "left")
        mean = F.when(F.col("mean").isNull(), F.col("error")).otherwise(smooth * F.col("error") + (1 - smooth) * F.col("mean"))
        goes = F.col("step").isNotNull() & (F.col("mean").isNull() | (F.col("mean") - mean >= tolerance * F.greatest(F.col("mean"), F.lit(1e-30))))
        met = met.select(KEY, F.when(F.col("step").isNotNull(), _product("step", "m")).otherwise(F.col("m")).alias("m"), mean.alias("mean"), F.lit(i + 1).alias("rounds"), F.coalesce(goes, F.lit(False)).alias("_goes"))
        met = table(met)
        ended = ended.unionByName(met.where("NOT _goes").drop("_goes"))
        live = met.where("_goes").drop("_goes")
    return ended.unionByName(live).select(KEY, "m", "rounds", F.col("mean").alias("error"))
