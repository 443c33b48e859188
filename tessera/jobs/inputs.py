"""Geometry read from the star-schema tables, so that every query's work grows with them.

soup: one face for each line item key, sixty vertices in each supplier's mesh
(open, non-manifold and degenerate edges and duplicate faces). terrain: customers
on a grid of fifty columns with their balance as height, two triangles a cell.
cloud: parts in space. track: events of a user in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import Mesh
from tessera.sources.scratch import merging

VERTICES, COLUMNS = 60, 50


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return merging(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Rows of one task where much is computed for each.
DEALT = 20_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to one task for each DEALT of them: a small file is one task to read, however long its rows take."""
    return rows.repartition(1 + rows.count() // DEALT, key)


def soup_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    o, n, p = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p")
    vids = F.array(p % VERTICES, o % VERTICES, (p * 7 + o * 3 + n) % VERTICES)
    return rows.select(F.col("l_suppkey").alias("mesh_id"), (o * 8 + n).alias("fid"), vids.alias("vids"))


def soup_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, s = F.col("vid"), F.col("s_suppkey")
    every = F.sequence(F.lit(0).cast("long"), F.lit(VERTICES - 1).cast("long"))
    p = read(spark, sf_dir, "supplier").withColumn("vid", F.explode(every))
    xyz = [((v * a + s * b) % m / 7.0).alias(c) for c, a, b, m in (("x", 37, 11, 101), ("y", 53, 29, 103), ("z", 71, 5, 107))]
    return p.select(s.alias("mesh_id"), "vid", *xyz)


def soup(spark: SparkSession, sf_dir: str) -> Mesh:
    return Mesh(soup_faces(spark, sf_dir), soup_points(spark, sf_dir))


def terrain_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.lit(0).cast("long").alias("mesh_id"), k.alias("vid"), (k % COLUMNS).cast("double").alias("x"), F.floor(k / COLUMNS).cast("double").alias("y"), (F.col("c_acctbal") / 1000).alias("z")
    )


def terrain(spark: SparkSession, sf_dir: str) -> Mesh:
    points = terrain_points(spark, sf_dir)
    k = F.col("vid")
    corner = points.where(k % COLUMNS < COLUMNS - 1).select("mesh_id", "vid")
    far = points.select("mesh_id", (k - COLUMNS - 1).alias("vid"))
    cells = corner.join(far, ["mesh_id", "vid"], "left_semi")
    two = F.explode(F.array(F.struct((k * 2).alias("fid"), F.array(k, k + 1, k + COLUMNS).alias("vids")), F.struct((k * 2 + 1).alias("fid"), F.array(k + 1, k + COLUMNS + 1, k + COLUMNS).alias("vids"))))
    return Mesh(cells.select("mesh_id", two.alias("f")).select("mesh_id", "f.fid", "f.vids"), points)


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.lit(0).cast("long").alias("mesh_id"), k.alias("vid"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 100).alias("y"), (k % 97).cast("double").alias("z")
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points (mesh_id, qid, x, y, z) from suppliers, in the cloud's box."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.lit(0).cast("long").alias("mesh_id"), s.alias("qid"), (s * 7 % 50).cast("double").alias("x"), (s * 13 % 11 + 9.5).cast("double").alias("y"), (s * 29 % 97).cast("double").alias("z")
    )


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among customers, one for each order: (mesh_id 0, eid, v0, v1) from the order's customer to its number."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.lit(0).cast("long").alias("mesh_id"), F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("v0"), (F.col("o_orderkey") % 4001).alias("v1"))


def segments2d(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, points) of short segments in the plane, one for each supplier, in pieces of a hundred."""
    s = F.col("s_suppkey")
    ends = read(spark, sf_dir, "supplier").select(F.floor(s / 100).alias("mesh_id"), s.alias("eid"), (s * 37 % 101).alias("x0"), (s * 53 % 103).alias("y0"), (s * 71 % 37 - 18).alias("dx"), (s * 29 % 41 - 20).alias("dy"))
    edges = ends.select("mesh_id", "eid", (F.col("eid") * 2).alias("v0"), (F.col("eid") * 2 + 1).alias("v1"))
    p = F.explode(F.array(F.struct((F.col("eid") * 2).alias("vid"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct((F.col("eid") * 2 + 1).alias("vid"), (F.col("x0") + F.col("dx")).alias("x"), (F.col("y0") + F.col("dy")).alias("y"))))
    points = ends.select("mesh_id", p.alias("p")).select("mesh_id", "p.vid", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return edges, points


def quad_terrain(spark: SparkSession, sf_dir: str) -> Mesh:
    """The terrain, a fiftieth as high, with one face of four corners a cell, named by its first corner."""
    m = terrain(spark, sf_dir)
    k = F.col("vids")[0]
    quads = m.faces.where(F.col("fid") % 2 == 0).select("mesh_id", k.alias("fid"), F.array(k, k + 1, k + COLUMNS + 1, k + COLUMNS).alias("vids"))
    return Mesh(quads, m.points.withColumn("z", F.col("z") / 50))


#: The sides of a box by its corners, bits of a corner's number telling its place on x, y and z.
BOX = ((0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5))


def quad_boxes(spark: SparkSession, sf_dir: str, move: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Mesh:
    """A box of six quads for each supplier, in a mesh of its own: its sides are 1 to 7 long, and move is in parts of them."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mesh_id"))
    size = 1 + F.col("mesh_id") % 7
    place = [[float(i >> k & 1) + m for k, m in enumerate(move)] for i in range(8)]
    p = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("vid"), *[(F.lit(c) * size).alias(a) for a, c in zip("xyz", xyz, strict=True)]) for i, xyz in enumerate(place)]))
    f = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("fid"), F.array(*[F.lit(v).cast("long") for v in side]).alias("vids")) for i, side in enumerate(BOX)]))
    return Mesh(s.select("mesh_id", f.alias("f")).select("mesh_id", "f.fid", "f.vids"), s.select("mesh_id", p.alias("p")).select("mesh_id", "p.*"))
