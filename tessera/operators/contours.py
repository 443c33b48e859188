"""Isocontours and isobands of a scalar on the vertices."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions import primitives as P
from tessera.model import KEY, Mesh, half_edges
from tessera.operators.clean import weld_soup
from tessera.operators.paths import connect_edges
from tessera.sources.scratch import table


def contour_points(mesh: Mesh, cuts: Sequence[float], scalar: str = "scalar") -> DataFrame:
    """mesh_id, fid, cut, lo, hi, x, y, z: where face sides cross a cut, strictly between their ends.

    Both faces of a side compute the point from its lower vertex, so it is the
    same. A vertex exactly at a cut makes no point.
    """
    at = lambda v: mesh.points.select(KEY, F.col("vid").alias(v), P.point().alias(f"p_{v}"), F.col(scalar).alias(f"s_{v}"))
    side = half_edges(mesh.faces).select(KEY, "fid", "lo", "hi").join(at("lo"), [KEY, "lo"]).join(at("hi"), [KEY, "hi"])
    levels = F.array(*[F.lit(float(c)) for c in sorted(cuts)])
    low, high = F.least("s_lo", "s_hi"), F.greatest("s_lo", "s_hi")
    side = side.withColumn("cut", F.explode(F.filter(levels, lambda c: (low < c) & (c < high))))
    t = (F.col("cut") - F.col("s_lo")) / (F.col("s_hi") - F.col("s_lo"))
    p = P.add(F.col("p_lo"), P.scale(P.sub(F.col("p_hi"), F.col("p_lo")), t))
    return side.select(KEY, "fid", "cut", "lo", "hi", p.alias("p")).select(KEY, "fid", "cut", "lo", "hi", "p.x", "p.y", "p.z")


def isocontours(mesh: Mesh, cuts: Sequence[float], scalar: str = "scalar") -> tuple[DataFrame, DataFrame]:
    """(edges, points): mesh_id, cut, eid, v0, v1 as structs <lo, hi>; points mesh_id, cut, v, x, y, z, each once."""
    c = contour_points(mesh, cuts, scalar).withColumn("v", F.struct("lo", "hi"))
    points = c.groupBy(KEY, "cut", "v").agg(*[F.min(a).alias(a) for a in "xyz"])
    edges = c.groupBy(KEY, "cut", "fid").agg(F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("n")).where("n = 2")
    return edges.select(KEY, "cut", F.col("fid").alias("eid"), "v0", "v1"), points


def isocontour_paths(mesh: Mesh, cuts: Sequence[float], scalar: str = "scalar") -> DataFrame:
    """Contours as paths, mesh_id being struct<mesh_id, cut> and vids structs <lo, hi>."""
    edges, _ = isocontours(mesh, cuts, scalar)
    return connect_edges(edges.select(F.struct(KEY, "cut").alias(KEY), "eid", "v0", "v1"))


def _banded(mesh: Mesh, cuts: Sequence[float], scalar: str, bands: Sequence[int] | None) -> DataFrame:
    """mesh_id, fid, band, pts: each face clipped to the bands it overlaps."""
    levels = sorted(float(c) for c in cuts)
    c = mesh.faces.select(KEY, "fid", F.posexplode("vids").alias("pos", "vid")).join(mesh.points.select(KEY, "vid", "x", "y", "z", F.col(scalar).alias("s")), [KEY, "vid"])
    flat = c.groupBy(KEY, "fid").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "z", "s"))).alias("c"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    band = lambda v: F.array_size(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x <= v))
    flat = flat.withColumn("_b0", band(F.col("lo"))).withColumn("_b1", band(F.col("hi")))
    whole = flat.where("_b0 = _b1").select(KEY, "fid", F.col("_b0").alias("band"), F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))).alias("pts"))
    cut = flat.where("_b0 <> _b1").select(KEY, "fid", F.transform("c", lambda p: F.array(p["x"], p["y"], p["z"], p["s"])).alias("c"))

    def run(parts):
        ends = [-np.inf, *levels, np.inf]
        for t in parts:
            rows = []
            for key, fid, c in t.itertuples(index=False):
                corners = [tuple(q.tolist()) for q in c]
                values = [q[3] for q in corners]
                for b in range(bisect_right(levels, min(values)), bisect_right(levels, max(values)) + 1):
                    p, v = [q[:3] for q in corners], values
                    if ends[b] > -np.inf:
                        p, v = kernels.clip(p, v, ends[b], True)
                    if ends[b + 1] < np.inf and p:
                        p, v = kernels.clip(p, v, ends[b + 1], False)
                    if len(p) >= 3 and kernels.has_area(p):
                        rows.append((key, fid, b, [{"x": x, "y": y, "z": z} for x, y, z in p]))
            yield pd.DataFrame(rows, columns=[KEY, "fid", "band", "pts"])

    out = whole.unionByName(cut.mapInPandas(run, f"{KEY} long, fid long, band int, pts array<struct<x: double, y: double, z: double>>"))
    return out if bands is None else out.where(F.col("band").isin(list(bands)))


def embedded_isocurves(mesh: Mesh, cuts: Sequence[float], scalar: str = "scalar") -> tuple[Mesh, DataFrame]:
    """(mesh whose faces are split along the contours, labels mesh_id, fid, band, src_fid).

    Band 0 lies below the first cut, then one for each interval. Faces within
    one band never reach Python.
    """
    return _labelled(_banded(mesh, cuts, scalar, None), len(cuts))


def isobands(mesh: Mesh, cuts: Sequence[float], bands: Sequence[int], scalar: str = "scalar") -> tuple[Mesh, DataFrame]:
    """As embedded_isocurves, but only the faces of selected bands."""
    return _labelled(_banded(mesh, cuts, scalar, bands), len(cuts))


def _labelled(pieces: DataFrame, n: int) -> tuple[Mesh, DataFrame]:
    # Written, as the weld and the labels read them many times over.
    named = table(pieces.select(KEY, (F.col("fid") * (n + 1) + F.col("band")).alias("fid"), F.col("fid").alias("src_fid"), "band", "pts"))
    return weld_soup(named.select(KEY, "fid", "pts")), named.select(KEY, "fid", "band", "src_fid")
