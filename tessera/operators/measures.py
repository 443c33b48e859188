"""Aggregates of point sets and meshes, one row for each mesh_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh, corners, fat_faces, half_edges
from tessera.operators.reindex import dense_ids
from tessera.sources.scratch import onto_points

AXES = P.AXES


def aabb(points: DataFrame) -> DataFrame:
    """Bounding box: mesh_id, min_x .. max_z."""
    return points.groupBy(KEY).agg(*[f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES])


def centroid(points: DataFrame) -> DataFrame:
    """The mean of the points."""
    return points.groupBy(KEY).agg(*[F.avg(a).alias(a) for a in AXES])


def mesh_centroid(mesh: Mesh) -> DataFrame:
    """The mean over face corners: a vertex counts once for each face that has it."""
    return centroid(corners(mesh))


def covariance(points: DataFrame) -> DataFrame:
    """The mean, the six covariances (divided by n), and n."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return points.groupBy(KEY).agg(*[F.avg(a).alias(f"mean_{a}") for a in AXES], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs], F.count("*").alias("n"))


def cross_covariance(left: DataFrame, right: DataFrame, on: str = "vid") -> DataFrame:
    """Of two point sets paired by (mesh_id, on): hab = mean of (a - mean a)(b - mean b), both means, n, and the spread of the left."""
    l = left.select(KEY, on, *[F.col(a).alias(f"l{a}") for a in AXES])
    r = right.select(KEY, on, *[F.col(a).alias(f"r{a}") for a in AXES])
    return l.join(r, [KEY, on]).groupBy(KEY).agg(
        *[F.covar_pop(f"l{a}", f"r{b}").alias(f"h{a}{b}") for a in AXES for b in AXES],
        *[F.avg(f"{s}{a}").alias(f"{s}{a}") for s in "lr" for a in AXES],
        (F.var_pop("lx") + F.var_pop("ly") + F.var_pop("lz")).alias("spread"),
        F.count("*").alias("n"),
    )


def _axes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Principal axes of each row of covariance(), the longest first, right-handed."""
    for t in parts:
        c = t[["cxx", "cxy", "cxz", "cxy", "cyy", "cyz", "cxz", "cyz", "czz"]].to_numpy().reshape(-1, 3, 3)
        _, v = np.linalg.eigh(np.nan_to_num(c))
        v = v[:, :, ::-1].transpose(0, 2, 1).copy()
        sign = np.sign(np.take_along_axis(v, np.abs(v).argmax(2)[:, :, None], 2))
        v *= np.where(sign == 0, 1, sign)
        v[:, 2] = np.cross(v[:, 0], v[:, 1])
        yield pd.DataFrame({KEY: t[KEY], "axes": list(v.reshape(-1, 9))})


def obb(points: DataFrame) -> DataFrame:
    """Oriented box along the principal axes: mesh_id, axes (three rows), ox, oy, oz (corner), e0, e1, e2 (extents).

    The covariances are plain aggregates; only one row a mesh goes through numpy.
    """
    frames = covariance(points).mapInPandas(_axes, f"{KEY} long, axes array<double>")
    p = points.select(KEY, *AXES).join(frames, KEY)
    along = [sum((F.col(a) * F.get("axes", F.lit(3 * k + i)) for i, a in enumerate(AXES)), F.lit(0.0)) for k in range(3)]
    ends = p.select(KEY, "axes", *[c.alias(f"s{k}") for k, c in enumerate(along)]).groupBy(KEY)
    ends = ends.agg(F.first("axes").alias("axes"), *[f(f"s{k}").alias(f"{n}{k}") for k in range(3) for n, f in (("lo", F.min), ("hi", F.max))])
    corner = [sum((F.col(f"lo{k}") * F.get("axes", F.lit(3 * k + i)) for k in range(3)), F.lit(0.0)).alias(f"o{a}") for i, a in enumerate(AXES)]
    return ends.select(KEY, "axes", *corner, *[(F.col(f"hi{k}") - F.col(f"lo{k}")).alias(f"e{k}") for k in range(3)])


def areas(mesh: Mesh) -> DataFrame:
    """mesh_id, fid, area of each face."""
    return fat_faces(mesh).select(KEY, "fid", P.area(F.col("pts")).alias("area"))


def total_area(mesh: Mesh) -> DataFrame:
    return areas(mesh).groupBy(KEY).agg(F.sum("area").alias("area"))


def _fan_volume(pts: Column) -> Column:
    """Six times the signed volume of the tetrahedra from the origin over the face's fan."""
    a = F.get(pts, F.lit(0))
    step = lambda s, i: s + P.dot(a, P.cross(F.get(pts, i), F.get(pts, i + 1)))
    return F.when(F.size(pts) >= 3, F.aggregate(F.sequence(F.lit(1), F.size(pts) - 2), F.lit(0.0), step)).otherwise(0.0)


def volume(mesh: Mesh) -> DataFrame:
    """mesh_id, signed_volume, volume."""
    v = fat_faces(mesh).groupBy(KEY).agg((F.sum(_fan_volume(F.col("pts"))) / 6).alias("signed_volume"))
    return v.withColumn("volume", F.abs("signed_volume"))


def edge_lengths(mesh: Mesh) -> DataFrame:
    """mesh_id, mean, min, max over face sides: a shared edge counts once for each face."""
    p = mesh.points.select(KEY, "vid", P.point().alias("p"))
    sides = half_edges(mesh.faces).select(KEY, "a", "b")
    a, b = p.select(KEY, F.col("vid").alias("a"), F.col("p").alias("pa")), p.select(KEY, F.col("vid").alias("b"), F.col("p").alias("pb"))
    n = onto_points(onto_points(sides, a, [KEY, "a"]), b, [KEY, "b"]).select(KEY, P.distance(F.col("pa"), F.col("pb")).alias("l"))
    return n.groupBy(KEY).agg(F.avg("l").alias("mean_edge"), F.min("l").alias("min_edge"), F.max("l").alias("max_edge"))


def face_normals(mesh: Mesh) -> DataFrame:
    """mesh_id, fid, n (unit, of the first three points; null without area)."""
    return fat_faces(mesh).select(KEY, "fid", "vids", P.face_normal(F.col("pts")).alias("n"))


def point_normals(mesh: Mesh) -> DataFrame:
    """mesh_id, vid, n: unit normals of the faces around a vertex summed and made a unit vector."""
    c = face_normals(mesh).where("n IS NOT NULL").select(KEY, F.explode("vids").alias("vid"), "n")
    s = c.groupBy(KEY, "vid").agg(*[F.sum(f"n.{a}").alias(a) for a in AXES])
    return s.select(KEY, "vid", P.normalized(P.point()).alias("n"))


def distance_field(points: DataFrame, measure, name: str = "scalar") -> DataFrame:
    """points with the distance to one primitive; measure takes the point, e.g. lambda p: plane_distance(p, n, d)."""
    return points.withColumn(name, measure(P.point()))


def boxes(mesh: Mesh) -> DataFrame:
    """mesh_id, fid, low, high, centre of each face."""
    p = F.col("pts")
    return fat_faces(mesh).select(KEY, "fid", P.box_low(p).alias("low"), P.box_high(p).alias("high"), P.centroid(p).alias("centre"))


def chamfer_error(nearest: DataFrame, outlier: float = 0.0) -> DataFrame:
    """Mean nearest distance per mesh from rows (mesh_id, qid, d2); the worst share outlier is left out.

    Ranks come from a sort across tasks, so no mesh has to fit one of them.
    """
    d = nearest.select(KEY, "qid", F.sqrt("d2").alias("d"))
    if outlier > 0:
        n = d.groupBy(KEY).agg(F.count("*").alias("n"))
        d = dense_ids(d, "d", "r").join(n, KEY).where(F.col("r") < F.col("n") - F.floor(F.col("n") * outlier))
    return d.groupBy(KEY).agg(F.avg("d").alias("chamfer"))


def shape_histogram(shape: DataFrame, bins: int = 10, low: float = -1.0, high: float = 1.0, column: str = "shape_index") -> DataFrame:
    """mesh_id, bin, n of a column over [low, high]."""
    k = F.floor((F.col(column) - low) / (high - low) * bins)
    return shape.where(F.col(column).isNotNull()).groupBy(KEY, F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
