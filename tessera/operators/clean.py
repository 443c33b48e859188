"""Removal of duplicate points, degenerate and duplicate elements, with the index maps that say what became of each id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import KEY, Mesh
from tessera.operators.reindex import equivalence_map, remapped_edges, remapped_faces, unique_map, used_points
from tessera.operators.topology import face_key
from tessera.sources.scratch import merging, table


def point_map(points: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Index map of points to the smallest id at the same place, or within chains of steps of tolerance at most.

    Without a tolerance this is one aggregate. With one, only points that have a
    near neighbour take part in the search for classes.
    """
    exact = unique_map(points, "vid", "x", "y", "z")
    if tolerance <= 0:
        return exact
    from tessera.operators.reindex import chained
    from tessera.operators.spatial import near_links

    exact = table(exact)
    kept = points.join(exact.where("old_id = new_id").select(KEY, F.col("old_id").alias("vid")), [KEY, "vid"], "left_semi")
    near = near_links(kept, tolerance)
    return chained(exact, equivalence_map(kept, "vid", near))


def clean_points(points: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(points, index map); the smallest id's position stays."""
    m = point_map(points, tolerance)
    return points.join(m.where("old_id = new_id").select(KEY, F.col("old_id").alias("vid")), [KEY, "vid"], "left_semi"), m


@dataclass
class Cleaned:
    mesh: Mesh
    point_map: DataFrame
    face_map: DataFrame


def clean_faces(mesh: Mesh, tolerance: float = 0.0) -> Cleaned:
    """Merge points; drop faces of fewer than three distinct vertices, duplicates of faces, and points no face uses.

    Vertices repeated next to each other are named once in a face that stays.
    """
    merged, m = clean_points(mesh.points, tolerance)
    m = table(m)
    faces = remapped_faces(mesh.faces, m).where(F.size(F.array_distinct("vids")) >= 3)
    n = F.size("vids")
    lean = F.filter("vids", lambda v, i: v != F.get("vids", (i + n - 1) % n))
    faces = table(faces.withColumn("vids", lean).withColumn("_k", face_key(F.col("vids"))))
    first = faces.groupBy(KEY, "_k").agg(F.min("fid").alias("_keep"))
    faces = table(faces.join(first, [KEY, "_k"]).select(KEY, "fid", "vids", "_keep"))
    kept = Mesh(faces.where("fid = _keep").select(KEY, "fid", "vids"), merged)
    points = used_points(kept)
    point_ids = m.join(points.select(KEY, F.col("vid").alias("new_id"), F.lit(True).alias("_in")), [KEY, "new_id"], "left")
    point_ids = point_ids.select(KEY, "old_id", F.when(F.col("_in"), F.col("new_id")).alias("new_id"))
    face_ids = mesh.faces.select(KEY, "fid").join(faces.select(KEY, "fid", "_keep"), [KEY, "fid"], "left").select(KEY, F.col("fid").alias("old_id"), F.col("_keep").alias("new_id"))
    return Cleaned(Mesh(kept.faces, points), point_ids, face_ids)


def clean_edges(edges: DataFrame, points: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, points, index map of edges): merge points, drop edges of no length, keep one of equal edges either way round."""
    merged, m = clean_points(points, tolerance)
    e = remapped_edges(edges, m).where("v0 <> v1").withColumns({"_lo": F.least("v0", "v1"), "_hi": F.greatest("v0", "v1")})
    e = table(e)
    first = e.groupBy(KEY, "_lo", "_hi").agg(F.min("eid").alias("_keep"))
    e = table(e.join(first, [KEY, "_lo", "_hi"]).select(KEY, "eid", "v0", "v1", "_keep"))
    kept = e.where("eid = _keep").select(KEY, "eid", "v0", "v1")
    used = kept.select(KEY, F.explode(F.array("v0", "v1")).alias("vid")).distinct()
    ids = edges.select(KEY, "eid").join(e.select(KEY, "eid", "_keep"), [KEY, "eid"], "left")
    return kept, merged.join(used, [KEY, "vid"], "left_semi"), ids.select(KEY, F.col("eid").alias("old_id"), F.col("_keep").alias("new_id"))


def clean_curves(paths: DataFrame, points: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(paths, points): the paths' edges are cleaned and connected anew."""
    from tessera.operators.paths import connect_edges

    step = F.transform(F.sequence(F.lit(0), F.size("vids") - 2), lambda i: F.struct(F.get("vids", i).alias("v0"), F.get("vids", i + 1).alias("v1")))
    e = paths.where(F.size("vids") >= 2).select(KEY, "path_id", F.posexplode(step).alias("_i", "e"))
    e = e.select(KEY, (F.shiftleft("path_id", 32) + F.col("_i")).alias("eid"), "e.v0", "e.v1")
    kept, merged, _ = clean_edges(e, points, tolerance)
    return connect_edges(kept), merged


def weld_soup(soup: DataFrame, tolerance: float = 0.0) -> Mesh:
    """Faces that carry their own points (mesh_id, fid, pts) as an indexed mesh.

    A corner's number is fid * 2**16 + its place; equal corners get the smallest.
    Faces with more corners, or ids too large for that, are an error.
    The exact weld groups corners by place once and rebuilds faces once.
    """
    c = soup.select(KEY, "fid", F.posexplode("pts").alias("pos", "p"))
    corner = F.when((F.col("pos") < 1 << 16) & (F.abs("fid") < 1 << 46), F.shiftleft("fid", 16) + F.col("pos")).otherwise(F.raise_error(F.lit("a face's id or corners are too many to number its corners")).cast("long"))
    c = c.select(KEY, "fid", "pos", corner.alias("vid"), "p.x", "p.y", "p.z")
    m = point_map(c, tolerance)
    points = c.join(merging(m.where("old_id = new_id").select(KEY, F.col("old_id").alias("vid"))), [KEY, "vid"], "left_semi")
    to = c.select(KEY, "fid", "pos", F.col("vid").alias("old_id")).join(m, [KEY, "old_id"])
    faces = to.groupBy(KEY, "fid").agg(F.sort_array(F.collect_list(F.struct("pos", "new_id"))).alias("c"))
    return Mesh(faces.select(KEY, "fid", F.col("c.new_id").alias("vids")), points.select(KEY, "vid", "x", "y", "z"))


def weld_segments(soup: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Segments that carry their own points (mesh_id, eid, pts of two) as cleaned (edges, points)."""
    m = weld_soup(soup.withColumnRenamed("eid", "fid"), tolerance)
    e = m.faces.select(KEY, F.col("fid").alias("eid"), F.get("vids", F.lit(0)).alias("v0"), F.get("vids", F.lit(1)).alias("v1"))
    return clean_edges(e, m.points)[:2]
