"""Polygons as triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions import primitives as P
from tessera.model import KEY, Mesh, fat_faces
from tessera.sources.scratch import merging


def fat_triangles(mesh: Mesh, ring: bool = False) -> DataFrame:
    """mesh_id, fid, tri, vids, pts: the triangles of each face with their points, tri numbering those of a face from 0 on.

    Triangles are taken as they are, convex quads as fans, other polygons by
    ear clipping; faces with fewer than three corners or a missing point are
    left out. ring adds the face's own vids and pts as face_vids and face_pts.
    """
    f = fat_faces(mesh).withColumn("n", F.size("vids")).where("n >= 3")
    if mesh.faces.where(F.size("vids") > 3).isEmpty():
        return f.select(KEY, "fid", F.lit(0).alias("tri"), "vids", "pts", *([F.col("vids").alias("face_vids"), F.col("pts").alias("face_pts")] if ring else []))
    corner = lambda i: P.sub(F.get("pts", F.lit((i + 1) % 4)), F.get("pts", F.lit(i)))
    turns = [P.dot(P.cross(corner(i), corner((i + 1) % 4)), P.newell(F.col("pts"))) for i in range(4)]
    easy = (F.col("n") == 3) | ((F.col("n") == 4) & (F.least(*turns) > 0))
    fan = F.transform(F.sequence(F.lit(1), F.col("n") - 2), lambda i: F.array(F.lit(0), i, i + 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in parts:
            flat, at = t.column(3).flatten(), np.r_[0, np.cumsum(np.asarray(pc.list_value_length(t.column(3))))]
            xyz = np.stack([np.asarray(flat.field(a)) for a in range(3)], 1)
            three = pa.array([[list(map(int, x)) for x in kernels.ear_clip(xyz[a:b])] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*t.columns, three], [*t.schema.names, "three"])

    kind = f.schema[KEY].dataType.simpleString()
    columns = (KEY, "fid", "vids", "pts")
    hard = f.where(~easy).select(*columns).mapInArrow(run, f"{KEY} {kind}, fid {f.schema['fid'].dataType.simpleString()}, vids {f.schema['vids'].dataType.simpleString()}, pts {f.schema['pts'].dataType.simpleString()}, three array<array<int>>")
    every = merging(f.where(easy).select(*columns, fan.alias("three")).unionByName(hard))
    every = every.select(*columns, F.posexplode("three").alias("tri", "_at"))
    of = lambda c: F.transform("_at", lambda i: F.get(c, i))
    return every.select(KEY, "fid", "tri", of("vids").alias("vids"), of("pts").alias("pts"), *([F.col("vids").alias("face_vids"), F.col("pts").alias("face_pts")] if ring else []))


def triangulated(mesh: Mesh, stride: int = 4096) -> DataFrame:
    """faces of triangles with src_fid, as fat_triangles makes them.

    New ids are src_fid * stride + the triangle's place; where a polygon has more
    triangles than that, the next power of two takes the stride's place for all.
    """
    most = (mesh.faces.agg(F.max(F.size("vids"))).first()[0] or 0) - 2
    stride = stride if most <= stride else 1 << (most - 1).bit_length()
    return fat_triangles(mesh).select(KEY, (F.col("fid") * stride + F.col("tri")).alias("fid"), "vids", F.col("fid").alias("src_fid"))


def closed_curves(paths: DataFrame, points: DataFrame) -> DataFrame:
    """Closed planar paths filled with triangles: mesh_id, fid, vids, src_fid (the path)."""
    loops = paths.where("closed").select(KEY, F.col("path_id").alias("fid"), F.slice("vids", F.lit(1), F.size("vids") - 1).alias("vids"))
    return triangulated(Mesh(loops, points))
