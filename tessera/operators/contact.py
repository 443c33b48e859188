"""Exact meetings and distances of forms: clouds, segment networks and meshes.

A form is a table (mesh_id, id, pts): pts are the three corners of a triangle,
and for a segment or a point the last one again. Faces of more corners are
several rows of one id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import contact
from tessera.functions import primitives as P
from tessera.model import KEY, Mesh
from tessera.operators.spatial import box_pairs
from tessera.operators.triangulate import fat_triangles
from tessera.sources.scratch import table

_PT = "struct<x: double, y: double, z: double>"


def of_faces(mesh: Mesh) -> DataFrame:
    return fat_triangles(mesh).select(KEY, F.col("fid").alias("id"), "pts")


def of_edges(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges with both ends among the points."""
    at = points.select(KEY, "vid", P.point().alias("p"))
    e = edges.select(KEY, F.col("eid").alias("id"), "v0", "v1")
    e = e.join(at.select(KEY, F.col("vid").alias("v0"), F.col("p").alias("p0")), [KEY, "v0"]).join(at.select(KEY, F.col("vid").alias("v1"), F.col("p").alias("p1")), [KEY, "v1"])
    return e.select(KEY, "id", F.array("p0", "p1", "p1").alias("pts"))


def of_points(points: DataFrame, id_col: str = "vid") -> DataFrame:
    p = P.point()
    return points.select(KEY, F.col(id_col).alias("id"), F.array(p, p, p).alias("pts"))


def of_boxes(boxes: DataFrame) -> DataFrame:
    """The surfaces of boxes (mesh_id, id, low, high), two triangles a side."""
    corner = lambda i: P.vec(*[F.col("high" if i >> k & 1 else "low")[a] for k, a in enumerate(P.AXES)])
    sides = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))
    three = [F.array(*[corner(i) for i in t]) for a, b, c, d in sides for t in ((a, b, c), (a, c, d))]
    return boxes.select(KEY, "id", F.explode(F.array(*three)).alias("pts"))


def _boxed(form: DataFrame, grow: Column | float = 0.0) -> DataFrame:
    """form, written, with a number for each row and its box."""
    p = F.col("pts")
    rows = form.withColumn("row", F.monotonically_increasing_id())
    return table(rows.withColumns({"low": P.each(lambda c: c - grow, P.box_low(p)), "high": P.each(lambda c: c + grow, P.box_high(p))}))


def _facing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two boxed forms whose boxes overlap: mesh_id, id0, id1, t0, t1."""
    met = box_pairs(*(t.select(KEY, F.col("row").alias("id"), "low", "high") for t in (a, b))).withColumnsRenamed({"id0": "r0", "id1": "r1"})
    side = lambda t, n: t.select(KEY, F.col("row").alias(f"r{n}"), F.col("id").alias(f"id{n}"), F.col("pts").alias(f"t{n}"))
    return met.join(side(a, 0), [KEY, "r0"]).join(side(b, 1), [KEY, "r1"]).select(KEY, "id0", "id1", "t0", "t1")


def _triangles(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.stack([np.asarray(flat.field(a)) for a in range(3)], 1).reshape(-1, 3, 3)


def _kinds(met: DataFrame) -> str:
    return ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in (KEY, "id0", "id1"))


def _exactly(met: DataFrame) -> DataFrame:
    """(mesh_id, id0, id1), each once, of the facing rows that share a point."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            ok = pa.array(contact.meets(_triangles(t.column(3)), _triangles(t.column(4))))
            yield pa.RecordBatch.from_arrays([t.column(k).filter(ok) for k in range(3)], [KEY, "id0", "id1"])

    return met.mapInArrow(run, _kinds(met)).distinct()


def gather_pairs(a: DataFrame, b: DataFrame, within: float = 0.0) -> DataFrame:
    """(mesh_id, id0, id1): members of two forms that share a point, or come within a distance, each pair once."""
    met = _facing(_boxed(a, within), _boxed(b))
    if within <= 0:
        return _exactly(met)
    return _measured(met).where(F.col("d2") <= within * within).select(KEY, "id0", "id1").distinct()


def gather_self_pairs(a: DataFrame) -> DataFrame:
    """(mesh_id, id0, id1), id0 < id1: members of one form that share a point; neighbours do, too."""
    boxed = _boxed(a)
    return _exactly(_facing(boxed, boxed).where("id0 < id1"))


def gather_ids(form: DataFrame, other: DataFrame) -> DataFrame:
    """(mesh_id, id) of the members that meet any of the other form's."""
    return gather_pairs(form, other).select(KEY, F.col("id0").alias("id")).distinct()


def forms_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """(mesh_id,) of the meshes whose two forms share a point."""
    return gather_pairs(a, b).select(KEY).distinct()


def _measured(met: DataFrame) -> DataFrame:
    """mesh_id, id0, id1, d2, p, q of facing rows: their closest points."""

    def points(xyz: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3)], list(P.AXES))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            d2, p, q = contact.closest(_triangles(t.column(3)), _triangles(t.column(4)))
            yield pa.RecordBatch.from_arrays([*t.columns[:3], pa.array(d2), points(p), points(q)], [KEY, "id0", "id1", "d2", "p", "q"])

    return met.mapInArrow(run, f"{_kinds(met)}, d2 double, p {_PT}, q {_PT}")


#: Rows of a form in one cell of the lowest level, about.
_LEAF = 16


def _levels(form: DataFrame, size: float, levels: int) -> list[DataFrame]:
    """Cells of a form on levels twice as coarse each, finest first: mesh_id, c<axis>, up<axis>, low, high, spot.

    A row belongs to the cell of its box's middle; low and high enclose all
    rows of a cell, and spot is a corner of one of them.
    """
    names = [f"c{a}" for a in P.AXES]
    middle = {f"c{a}": F.floor((F.col("low")[a] + F.col("high")[a]) / (2 * size)) for a in P.AXES}
    rows, out = form.withColumns(middle).withColumn("spot", F.get("pts", F.lit(0))), []
    for _ in range(levels + 1):
        ends = [f(F.col(c)[a]).alias(f"_{c}{a}") for c, f in (("low", F.min), ("high", F.max)) for a in P.AXES]
        cells = rows.groupBy(KEY, *names).agg(*ends, F.min("spot").alias("spot"))
        box = [P.vec(*[F.col(f"_{c}{a}") for a in P.AXES]).alias(c) for c in ("low", "high")]
        out.append(table(cells.select(KEY, *names, *[F.floor(F.col(c) / 2).alias(f"up{c}") for c in names], *box, "spot")))
        rows = out[-1].select(KEY, *[F.col(f"up{c}").alias(c) for c in names], "low", "high", "spot")
    return out


def closest_members(a: DataFrame, b: DataFrame) -> DataFrame:
    """The closest pair of members of two forms, one row for each mesh_id that both have: mesh_id, id0, id1, d2, p, q.

    Pairs of cells, one of each form, are split level by level. A pair is as
    far apart as its boxes at least and as two of its points at most, and goes
    where the first is more than the smallest of the second in its mesh. The
    members of what is left on the finest level are measured exactly. Ties go
    to the smaller id0 and id1; members that meet are at distance 0.
    """
    a, b = _boxed(a), _boxed(b)
    both = a.unionByName(b)
    ends = both.agg(F.count("*"), *[f(F.col(c)[x]) for x in P.AXES for c, f in (("low", F.min), ("high", F.max))]).first()
    spans = [ends[2 + 2 * i] - ends[1 + 2 * i] for i in range(3)] if ends[0] else [0.0]
    live = [s for s in spans if s > 0] or [1.0]
    meshes = max(1, both.select(KEY).distinct().count()) if ends[0] else 1
    size = max((math.prod(live) * _LEAF / max(1, ends[0] / meshes)) ** (1 / len(live)), max(live) * 2.0**-20)
    levels = max(0, math.ceil(math.log2(max(max(live) / size, 1.0))))
    names = [f"c{x}" for x in P.AXES]
    trees = [_levels(t, size, levels) for t in (a, b)]
    side = lambda t, n, *more: t.select(KEY, *[F.col(c).alias(f"{c}{n}") for c in (*names, "low", "high", "spot", *more)])
    pairs = side(trees[0][levels], 0).join(side(trees[1][levels], 1), KEY)
    for level in range(levels, -1, -1):
        if level < levels:
            for n in (0, 1):
                below = side(trees[n][level], n, *[f"up{c}" for c in names])
                below = below.withColumnsRenamed({f"{c}{n}": f"_{c}{n}" for c in names} | {f"up{c}{n}": f"{c}{n}" for c in names})
                pairs = pairs.drop(f"low{n}", f"high{n}", f"spot{n}", "bound").join(below, [KEY, *[f"{c}{n}" for c in names]])
                pairs = pairs.drop(*[f"{c}{n}" for c in names]).withColumnsRenamed({f"_{c}{n}": f"{c}{n}" for c in names})
        pairs = pairs.withColumns({"least": P.box_box_distance2(*[F.col(c) for c in ("low0", "high0", "low1", "high1")]), "most": P.distance2(F.col("spot0"), F.col("spot1"))})
        pairs = table(pairs)
        bound = pairs.groupBy(KEY).agg(F.min("most").alias("bound"))
        pairs = pairs.join(bound, KEY).where(F.col("least") <= F.col("bound") * (1 + 1e-9))
    left = table(pairs.select(KEY, *[f"{c}{n}" for c in names for n in (0, 1)], "bound"))
    for n, form in enumerate((a, b)):
        cells = {f"c{x}{n}": F.floor((F.col("low")[x] + F.col("high")[x]) / (2 * size)) for x in P.AXES}
        rows = form.withColumns(cells).select(KEY, *cells, F.col("id").alias(f"id{n}"), F.col("pts").alias(f"t{n}"), F.col("low").alias(f"low{n}"), F.col("high").alias(f"high{n}"))
        left = left.join(rows, [KEY, *cells])
    near = left.where(P.box_box_distance2(*[F.col(c) for c in ("low0", "high0", "low1", "high1")]) <= F.col("bound") * (1 + 1e-9))
    best = _measured(near.select(KEY, "id0", "id1", "t0", "t1")).groupBy(KEY).agg(F.min(F.struct("d2", "id0", "id1", "p", "q")).alias("b"))
    return best.select(KEY, "b.id0", "b.id1", "b.d2", "b.p", "b.q")


def form_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    return closest_members(a, b).select(KEY, F.sqrt("d2").alias("distance"))
