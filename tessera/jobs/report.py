"""Quality report of a corpus of meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh, fat_faces
from tessera.operators.measures import _fan_volume
from tessera.operators.topology import edge_counts


def mesh_report(mesh: Mesh) -> DataFrame:
    """One row a mesh: faces, edges, boundary and non-manifold edges, closed, manifold, area, signed volume.

    Two shuffles of faces: one on vertices for coordinates, one on edges; what
    reaches the last aggregates is one row a face or edge.
    """
    n = F.count_if
    e = edge_counts(mesh.faces).groupBy(KEY).agg(F.count("*").alias("n_edges"), n(F.col("n_faces") == 1).alias("n_boundary"), n(F.col("n_faces") > 2).alias("n_non_manifold"))
    p = F.col("pts")
    f = fat_faces(mesh).select(KEY, P.area(p).alias("a"), _fan_volume(p).alias("v"))
    f = f.groupBy(KEY).agg(F.count("*").alias("n_faces"), F.sum("a").alias("area"), (F.sum("v") / 6).alias("signed_volume"))
    out = f.join(e, KEY)
    return out.select(KEY, "n_faces", "n_edges", "n_boundary", "n_non_manifold", (F.col("n_boundary") == 0).alias("is_closed"), (F.col("n_non_manifold") == 0).alias("is_manifold"), "area", "signed_volume")
