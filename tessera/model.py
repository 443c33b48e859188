"""Tables of a corpus of meshes, and the derived tables most operators start from.

points(mesh_id, vid, x, y, z)   faces(mesh_id, fid, vids array<long>)
edges(mesh_id, eid, v0, v1)     paths(mesh_id, path_id, vids array<long>, closed)

Every operator keeps mesh_id as a key, so one job serves one mesh or millions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.scratch import merging

#: Square root of the double's epsilon, and the epsilon itself.
EPS = 1.49e-8
EPS2 = 2.22e-16

KEY = "mesh_id"


@dataclass
class Mesh:
    """Faces and the points their vids name; joins of either are merged (see scratch.merging)."""

    faces: DataFrame
    points: DataFrame

    def __post_init__(self) -> None:
        # Spark forgets the hint at a join or a union, as most tables here have been through.
        self.faces, self.points = merging(self.faces), merging(self.points)


def half_edges(faces: DataFrame) -> DataFrame:
    """One row for each side of each face: mesh_id, fid, pos, a, b (as the face runs), lo, hi."""
    n = F.size("vids")
    side = faces.select(KEY, "fid", F.posexplode("vids").alias("pos", "a"), "vids")
    side = side.withColumn("b", F.get("vids", (F.col("pos") + 1) % n)).drop("vids")
    return side.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})


def corners(mesh: Mesh) -> DataFrame:
    """One row for each corner of each face with its coordinates and the number of the face's corners: one shuffle on (mesh_id, vid)."""
    c = mesh.faces.select(KEY, "fid", F.size("vids").alias("n"), F.posexplode("vids").alias("pos", "vid"))
    return c.join(mesh.points.select(KEY, "vid", "x", "y", "z"), [KEY, "vid"])


def fat_faces(mesh: Mesh) -> DataFrame:
    """mesh_id, fid, vids, pts: each face with its points in order. Faces with a missing point are left out."""
    c = corners(mesh).groupBy(KEY, "fid").agg(F.sort_array(F.collect_list(F.struct("pos", "vid", "x", "y", "z"))).alias("c"), F.max("n").alias("n"))
    pts = F.transform("c", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    return merging(c.where(F.size("c") == F.col("n")).select(KEY, "fid", F.col("c.vid").alias("vids"), pts.alias("pts")))
