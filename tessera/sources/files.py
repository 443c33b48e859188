"""STL and OBJ corpora: one file is one mesh."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh, fat_faces
from tessera.operators.clean import weld_soup
from tessera.operators.reindex import dense_ids, remapped_faces
from tessera.sources.scratch import table

_PTS = "array<struct<x: double, y: double, z: double>>"
_STL = np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")])
_VERTEX = re.compile(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)")


def parse_stl(data: bytes) -> np.ndarray:
    """Triangles (n, 3, 3) of a binary or text file; the size tells which."""
    if len(data) >= 84 and len(data) == 84 + 50 * int.from_bytes(data[80:84], "little"):
        return np.frombuffer(data, _STL, offset=84)["p"].astype(float)
    return np.array(_VERTEX.findall(data), dtype=float).reshape(-1, 3, 3)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias(KEY), "path", "content")


def read_stl(spark: SparkSession, path: str, tolerance: float = 0.0) -> Mesh:
    """All STL files of a path; mesh_id is a hash of the file's path. Vertices are welded."""

    def run(parts):
        for t in parts:
            for key, data in zip(t[KEY], t["content"], strict=True):
                tri = parse_stl(data)
                pts = [[{"x": x, "y": y, "z": z} for x, y, z in p] for p in tri.tolist()]
                yield pd.DataFrame({KEY: key, "fid": np.arange(len(tri)), "pts": pts})

    soup = _files(spark, path).select(KEY, "content").mapInPandas(run, f"{KEY} long, fid long, pts {_PTS}")
    return weld_soup(table(soup), tolerance)


def read_obj(spark: SparkSession, path: str) -> Mesh:
    """All OBJ files of a path: v and f lines, vertices counted from 1 (or back from the end); texture and normal numbers are left out."""

    def run(parts):
        for t in parts:
            for key, data in zip(t[KEY], t["content"], strict=True):
                rows, nv, nf = [], 0, 0
                for line in data.decode("utf-8", "replace").splitlines():
                    w = line.split()
                    if w[:1] == ["v"]:
                        rows.append((key, nv, [float(x) for x in w[1:4]], None))
                        nv += 1
                    elif w[:1] == ["f"]:
                        at = [int(x.split("/")[0]) for x in w[1:]]
                        rows.append((key, nf, None, [a - 1 if a > 0 else nv + a for a in at]))
                        nf += 1
                yield pd.DataFrame(rows, columns=[KEY, "k", "p", "vids"])

    both = table(_files(spark, path).select(KEY, "content").mapInPandas(run, f"{KEY} long, k long, p array<double>, vids array<long>"))
    points = both.where("p IS NOT NULL").select(KEY, F.col("k").alias("vid"), *[F.get("p", F.lit(i)).alias(a) for i, a in enumerate("xyz")])
    return Mesh(both.where("vids IS NOT NULL").select(KEY, F.col("k").alias("fid"), "vids"), points)


def stl_files(mesh: Mesh) -> DataFrame:
    """mesh_id, content: a binary STL for each mesh of a corpus of small ones, normals from the faces."""

    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("fid")
        p = np.array([[[q["x"], q["y"], q["z"]] for q in pts] for pts in t["pts"]])
        n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        out = np.zeros(len(p), _STL)
        out["n"], out["p"] = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300), p
        return pd.DataFrame({KEY: [key[0]], "content": [bytes(80) + len(p).to_bytes(4, "little") + out.tobytes()]})

    return fat_faces(mesh).select(KEY, "fid", "pts").groupBy(KEY).applyInPandas(run, f"{KEY} long, content binary")


def _vector(v: Column) -> Column:
    return F.concat_ws(" ", *[v[a] for a in P.AXES])


def stl_lines(mesh: Mesh) -> DataFrame:
    """mesh_id, k, id, line: the lines of a text STL in the order of k and id. Faces without area have the normal 0 0 0."""
    p = F.col("pts")
    corner = [F.concat(F.lit("vertex "), _vector(F.get(p, F.lit(i)))) for i in range(3)]
    normal = P.face_normal(p)
    n = F.when(normal.isNull(), F.lit("0 0 0")).otherwise(_vector(normal))
    facet = F.concat_ws("\n", F.concat(F.lit("facet normal "), n), F.lit("outer loop"), *corner, F.lit("endloop"), F.lit("endfacet"))
    f = fat_faces(mesh).select(KEY, F.lit(1).alias("k"), F.col("fid").alias("id"), facet.alias("line"))
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("line")) for k, x in ((0, "solid mesh"), (2, "endsolid mesh"))]))
    return f.unionByName(mesh.faces.select(KEY).distinct().select(KEY, ends.alias("e")).select(KEY, "e.k", F.lit(0).cast("long").alias("id"), "e.line"))


def obj_lines(mesh: Mesh) -> DataFrame:
    """mesh_id, k, id, line: the lines of an OBJ file in the order of k and id; vertices are numbered in order of vid."""
    points = mesh.points.select(KEY, F.lit(0).alias("k"), F.col("vid").alias("id"), F.concat(F.lit("v "), _vector(P.point())).alias("line"))
    ids = dense_ids(mesh.points.select(KEY, F.col("vid").alias("old_id")), "old_id")
    numbers = F.array_join(F.transform("vids", lambda v: (v + 1).cast("string")), " ")
    faces = remapped_faces(mesh.faces, ids).select(KEY, F.lit(1).alias("k"), F.col("fid").alias("id"), F.concat(F.lit("f "), numbers).alias("line"))
    return points.unionByName(faces)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file for each mesh, in a folder of its own (mesh_id=...): lines stream through one task a mesh and are never held together."""
    lines.repartition(KEY).sortWithinPartitions(KEY, "k", "id").select(KEY, "line").write.partitionBy(KEY).text(path)
