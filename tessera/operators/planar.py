"""Segments in the plane: crossings, and the arrangement they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY
from tessera.operators.clean import clean_edges
from tessera.operators.paths import planar_embedding
from tessera.operators.meeting import self_box_pairs
from tessera.sources.scratch import table


def _ends(edges: DataFrame, points: DataFrame) -> DataFrame:
    p = lambda v: points.select(KEY, F.col("vid").alias(v), P.vec(F.col("x"), F.col("y")).alias(f"p{v[1]}"))
    return edges.join(p("v0"), [KEY, "v0"]).join(p("v1"), [KEY, "v1"])


def crossings(edges: DataFrame, points: DataFrame) -> DataFrame:
    """mesh_id, id0, id1, s, t, x, y, at0, at1: where two segments meet in one point.

    s and t are places along each; at0 and at1 say start, end or edge. Segments
    along one line don't cross.
    """
    e = table(_ends(edges, points))
    low = lambda f: P.each(lambda a, b: f(a, b), F.col("p0"), F.col("p1"))
    boxes = e.select(KEY, F.col("eid").alias("id"), low(F.least).alias("low"), low(F.greatest).alias("high"))
    met = self_box_pairs(boxes)
    side = lambda n: e.select(KEY, F.col("eid").alias(f"id{n}"), F.col("p0").alias(f"a{n}"), F.col("p1").alias(f"b{n}"))
    both = met.join(side(0), [KEY, "id0"]).join(side(1), [KEY, "id1"])
    both = both.withColumn("c", P.segments_cross2d(F.col("a0"), F.col("b0"), F.col("a1"), F.col("b1"))).where("c IS NOT NULL")
    place = lambda k: F.when(F.col(f"c.{k}") <= 1e-9, "start").when(F.col(f"c.{k}") >= 1 - 1e-9, "end").otherwise("edge")
    return both.select(KEY, "id0", "id1", "c.s", "c.t", "c.x", "c.y", place("s").alias("at0"), place("t").alias("at1"))


def arrangement(edges: DataFrame, points: DataFrame, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(edges, points) with every segment split at its crossings and equal pieces kept once."""
    c = table(crossings(edges, points))
    e = _ends(edges, points)
    stops = c.select(KEY, F.col("id0").alias("eid"), F.col("s").alias("k"), "x", "y").unionByName(c.select(KEY, F.col("id1").alias("eid"), F.col("t").alias("k"), "x", "y"))
    for k, p in ((0.0, "p0"), (1.0, "p1")):
        stops = stops.unionByName(e.select(KEY, "eid", F.lit(k).alias("k"), F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y")))
    # One name for each place: its rounded coordinates.
    grid = 1e7
    stops = stops.withColumns({"x": F.round(F.col("x") * grid) / grid + 0.0, "y": F.round(F.col("y") * grid) / grid + 0.0})
    stops = table(stops.withColumn("vid", F.xxhash64("x", "y").bitwiseAND((1 << 62) - 1)))
    w = Window.partitionBy(KEY, "eid").orderBy("k", "x", "y")
    parts = stops.withColumns({"v1": F.lead("vid").over(w), "_n": F.row_number().over(w)}).where("v1 IS NOT NULL")
    parts = parts.select(KEY, F.when((F.col("_n") < 1 << 20) & (F.abs("eid") < 1 << 42), F.col("eid") * (1 << 20) + F.col("_n")).otherwise(F.raise_error(F.lit("an edge's id or pieces are too many to number its pieces")).cast("long")).alias("eid"), F.col("vid").alias("v0"), "v1")
    places = stops.groupBy(KEY, "vid").agg(F.min("x").alias("x"), F.min("y").alias("y")).withColumn("z", F.lit(0.0))
    out, kept, _ = clean_edges(parts, places)
    return out, kept


def planar_arrangement(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Faces and holes of the arrangement of segments, as planar_embedding gives them."""
    e, p = arrangement(edges, points)
    return planar_embedding(table(e), table(p))
