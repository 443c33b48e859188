"""Index maps, and the tables that follow them. An index map is (mesh_id, old_id, new_id), new_id null for what goes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh
from tessera.operators.graph import connected_components
from tessera.sources.scratch import merging, table


def dense_ids(rows: DataFrame, order: str, name: str = "new_id") -> DataFrame:
    """rows with a number from 0 on within each mesh, in order.

    Rows are sorted across tasks by (mesh_id, order); each task numbers its own
    stretch and adds the counts of the stretches before it, so no mesh has to
    fit one task. Only one row for each task and mesh is summed up.
    """
    at = table(rows.orderBy(KEY, order).withColumn("_k", F.monotonically_increasing_id()))
    part = F.shiftright("_k", 33)
    stretch = at.groupBy(KEY, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_k").alias("_first"))
    earlier = Window.partitionBy(KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = stretch.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return merging(at.withColumn("_part", part).join(before, [KEY, "_part"]).withColumn(name, F.col("_before") + F.col("_k") - F.col("_first")).drop("_k", "_part", "_first", "_before"))


def mask_map(rows: DataFrame, id_col: str, keep: Column, dense: bool = True) -> DataFrame:
    """Index map of the rows that keep selects; numbered anew in order of id, or under their own ids."""
    ids = rows.select(KEY, F.col(id_col).alias("old_id"), keep.alias("_keep"))
    kept = ids.where("_keep").select(KEY, "old_id")
    kept = dense_ids(kept, "old_id") if dense else kept.withColumn("new_id", F.col("old_id"))
    return ids.drop("_keep").join(kept, [KEY, "old_id"], "left")


def ids_map(rows: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """Index map from wanted (mesh_id, old_id, new_id): new_id is the place in the list."""
    return rows.select(KEY, F.col(id_col).alias("old_id")).join(wanted, [KEY, "old_id"], "left")


def unique_map(rows: DataFrame, id_col: str, *key: str) -> DataFrame:
    """Index map to the smallest id among rows with equal keys."""
    k = F.struct(*key)
    first = rows.groupBy(KEY, k.alias("_k")).agg(F.min(id_col).alias("new_id"))
    return merging(rows.select(KEY, F.col(id_col).alias("old_id"), k.alias("_k")).join(merging(first), [KEY, "_k"]).select(KEY, "old_id", "new_id"))


def equivalence_map(rows: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """Index map to the smallest id of each class that pairs (mesh_id, id0, id1) connect."""
    found = connected_components(pairs, "id0", "id1", [KEY]).select(KEY, F.col("node").alias("old_id"), F.col("label").alias("new_id"))
    ids = rows.select(KEY, F.col(id_col).alias("old_id"))
    return merging(ids.join(found, [KEY, "old_id"], "left").withColumn("new_id", F.coalesce("new_id", "old_id")))


def densified(index_map: DataFrame) -> DataFrame:
    """The same map with new ids from 0 on."""
    new = dense_ids(index_map.where("new_id IS NOT NULL").select(KEY, F.col("new_id").alias("_c")).distinct(), "_c", "_d")
    return index_map.withColumnRenamed("new_id", "_c").join(new, [KEY, "_c"], "left").select(KEY, "old_id", F.col("_d").alias("new_id"))


def chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """second after first; what either removes is removed."""
    s = second.select(KEY, F.col("old_id").alias("_m"), F.col("new_id").alias("_n"))
    return merging(first.withColumnRenamed("new_id", "_m").join(merging(s), [KEY, "_m"], "left").select(KEY, "old_id", F.col("_n").alias("new_id")))


def inverted(index_map: DataFrame) -> DataFrame:
    """From new ids to the smallest old id; removed ids have no row."""
    return index_map.where("new_id IS NOT NULL").groupBy(KEY, F.col("new_id").alias("old_id")).agg(F.min("old_id").alias("new_id"))


def reindexed(rows: DataFrame, index_map: DataFrame, id_col: str) -> DataFrame:
    """rows (points, attributes) under their new ids; of several that become one, the smallest old id stays."""
    first = inverted(index_map).select(KEY, F.col("new_id").alias(id_col), F.col("old_id").alias("_n"))
    return rows.join(first, [KEY, id_col]).withColumn(id_col, F.col("_n")).select(*rows.columns)


def remapped_faces(faces: DataFrame, index_map: DataFrame) -> DataFrame:
    """faces with new vertex ids; a face with a removed vertex goes."""
    c = faces.select(KEY, "fid", F.posexplode("vids").alias("pos", "old_id")).join(merging(index_map), [KEY, "old_id"], "left")
    back = c.groupBy(KEY, "fid").agg(F.sort_array(F.collect_list(F.struct("pos", "new_id"))).alias("c"), F.bool_and(F.col("new_id").isNotNull()).alias("ok"))
    return merging(back.where("ok").select(KEY, "fid", F.col("c.new_id").alias("vids")))


def remapped_edges(edges: DataFrame, index_map: DataFrame) -> DataFrame:
    """edges with new vertex ids; an edge with a removed end goes."""
    for v in ("v0", "v1"):
        m = index_map.where("new_id IS NOT NULL").select(KEY, F.col("old_id").alias(v), F.col("new_id").alias("_n"))
        edges = edges.join(m, [KEY, v]).withColumn(v, F.col("_n")).drop("_n")
    return edges.select(KEY, "eid", "v0", "v1")


def used_points(mesh: Mesh) -> DataFrame:
    """points that a face names."""
    return mesh.points.join(mesh.faces.select(KEY, F.explode("vids").alias("vid")).distinct(), [KEY, "vid"], "left_semi")


def faces_by_mask(mesh: Mesh, keep: Column) -> Mesh:
    """The faces that keep selects, and their points only."""
    out = Mesh(mesh.faces.where(keep), mesh.points)
    return Mesh(out.faces, used_points(out))


def faces_by_ids(mesh: Mesh, ids: DataFrame) -> Mesh:
    """The faces of ids (mesh_id, fid), and their points only."""
    out = Mesh(mesh.faces.join(ids.select(KEY, "fid").distinct(), [KEY, "fid"], "left_semi"), mesh.points)
    return Mesh(out.faces, used_points(out))


def points_by_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    """points of ids (mesh_id, vid, pos) in the order given: pos becomes the vid."""
    return points.join(ids.select(KEY, "vid", "pos"), [KEY, "vid"]).withColumn("vid", F.col("pos").cast("long")).select(*points.columns)


def faces_by_points(mesh: Mesh, keep: DataFrame) -> Mesh:
    """The points of keep (mesh_id, vid), used or not, and the faces whose vertices are all among them."""
    wanted = keep.select(KEY, "vid").distinct().withColumn("_in", F.lit(True))
    c = mesh.faces.select(KEY, "fid", F.explode("vids").alias("vid")).join(wanted, [KEY, "vid"], "left")
    ok = c.groupBy(KEY, "fid").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("ok")).where("ok")
    return Mesh(mesh.faces.join(ok.select(KEY, "fid"), [KEY, "fid"], "left_semi"), mesh.points.join(wanted, [KEY, "vid"], "left_semi"))


def edges_by_points(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges with both ends among keep (mesh_id, vid)."""
    for v in ("v0", "v1"):
        edges = edges.join(keep.select(KEY, F.col("vid").alias(v)).distinct(), [KEY, v], "left_semi")
    return edges.select(KEY, "eid", "v0", "v1")


def _moved(by: int):
    return lambda v: v + by


def concatenated(*meshes: Mesh, transforms: list | None = None, stride: int = 1 << 32) -> Mesh:
    """One mesh from several: ids of the k-th are moved by k * stride, its points by its transformation. Ids from 0 to stride - 1 fit; others are an error."""
    faces, points = [], []
    fits = lambda c, by: F.when((c >= 0) & (c < stride), c + by).otherwise(F.raise_error(F.lit("an id doesn't fit the stride")).cast("long"))
    for k, m in enumerate(meshes):
        p = m.points.select(KEY, fits(F.col("vid"), k * stride).alias("vid"), (P.transform_point(P.point(), transforms[k]) if transforms and transforms[k] else P.point()).alias("p"))
        points.append(p.select(KEY, "vid", "p.x", "p.y", "p.z"))
        faces.append(m.faces.select(KEY, fits(F.col("fid"), k * stride).alias("fid"), F.transform("vids", _moved(k * stride)).alias("vids")))
    return Mesh(reduce(DataFrame.unionByName, faces), reduce(DataFrame.unionByName, points))


def split_by_label(mesh: Mesh, labels: DataFrame) -> Mesh:
    """Each label of a mesh as a mesh of its own; points that several labels use are copied. mesh_id becomes struct<mesh_id, label>."""
    f = mesh.faces.join(labels, [KEY, "fid"]).withColumn("_new", F.struct(KEY, "label"))
    used = f.select(KEY, "_new", F.explode("vids").alias("vid")).distinct()
    points = used.join(mesh.points, [KEY, "vid"]).drop(KEY).withColumnRenamed("_new", KEY)
    return Mesh(f.select(F.col("_new").alias(KEY), "fid", "vids"), points.select(KEY, "vid", "x", "y", "z"))
