"""Registered queries whose results are what defines an operator's answer, so that SQL can tell them: counts of paths, windings, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.jobs import inputs as I
from tessera.jobs.queries import SOUP, TERRAIN, _labels_sql, _round, query
from tessera.model import KEY, Mesh
from tessera.operators import clean, measures, paths, topology


def _counts_sql(edges: str) -> str:
    """Paths through undirected edges e (a < b): those between vertices of degree other than 2, and loops of degree 2 alone."""
    return _labels_sql(f"e AS ({edges})", "SELECT a AS k FROM e UNION SELECT b FROM e", "SELECT a, b FROM e UNION SELECT b, a FROM e",
        """, g AS (SELECT k, count(*) AS n FROM (SELECT a AS k FROM e UNION ALL SELECT b FROM e) GROUP BY k),
        p AS (SELECT label, sum(CASE WHEN n <> 2 THEN n ELSE 0 END) // 2 AS n FROM g JOIN r USING (k) GROUP BY label)
        SELECT sum(greatest(n, 1))::BIGINT AS n_paths, (SELECT count(*) FROM e) AS n_steps FROM p""")  # fmt: skip


def _path_counts(p: DataFrame) -> DataFrame:
    return p.agg(F.count("*").alias("n_paths"), F.sum(F.size("vids") - 1).cast("long").alias("n_steps"))


@query(_counts_sql("SELECT DISTINCT least(o_custkey, o_orderkey % 4001) AS a, greatest(o_custkey, o_orderkey % 4001) AS b FROM orders WHERE o_custkey <> o_orderkey % 4001"))
def t19_path_counts(spark, d):
    return _path_counts(paths.connect_edges(I.order_edges(spark, d)))


@query(_counts_sql("SELECT DISTINCT least(o_custkey % 500, o_orderkey % 4001 % 500) AS a, greatest(o_custkey % 500, o_orderkey % 4001 % 500) AS b FROM orders WHERE o_custkey % 500 <> o_orderkey % 4001 % 500"))
def c5_curve_counts(spark, d):
    """Curves through customers and order numbers once such as lie at one place are one."""
    e = I.order_edges(spark, d)
    p = paths.connect_edges(e).withColumn("path_id", F.col("path_id").cast("long"))
    at = e.select(KEY, F.explode(F.array("v0", "v1")).alias("vid")).distinct().select(KEY, "vid", (F.col("vid") % 500).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return _path_counts(clean.clean_curves(p, at)[0])


@query(f"""WITH {TERRAIN}, t AS (SELECT f.fid, f.vids, (-(b.z - a.z) * (c.y - a.y) + (b.y - a.y) * (c.z - a.z)) ** 2 + ((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z)) ** 2 + ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) ** 2 AS w
        FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3]),
    v AS (SELECT sum(CASE WHEN fid % 7 < 2 THEN -w ELSE w END) > 0 AS up FROM t)
    SELECT fid, up AS as_first, vids[1] + vids[2] + vids[3] AS vid_sum FROM t, v""")
def t16_terrain_winding(spark, d):
    """The terrain with two of seven faces turned over: all run the way that the larger squared area did."""
    m = I.terrain(spark, d)
    turned = m.faces.withColumn("vids", F.when(F.col("fid") % 7 < 2, F.reverse("vids")).otherwise(F.col("vids")))
    out = topology.orient_consistently(Mesh(turned, m.points)).select("fid", F.col("vids").alias("now"))
    # One way round is the other reversed: the corner after the smallest one tells.
    after = lambda c: F.get(c, (F.array_position(c, F.array_min(c)) % 3).cast("int"))
    both = out.join(m.faces, "fid")
    return both.select("fid", (after(F.col("now")) == after(F.col("vids"))).alias("as_first"), F.aggregate("now", F.lit(0).cast("long"), lambda a, x: a + x).alias("vid_sum"))


@query("SELECT s_suppkey AS mesh_id, round(power(1 + s_suppkey % 7, 3), 5) AS signed_volume FROM supplier")
def g10_positive_boxes(spark, d):
    """Boxes with sides turned over by a rule, oriented outwards again."""
    m = I.quad_boxes(spark, d)
    turned = m.faces.withColumn("vids", F.when((F.col("fid") + F.col(KEY)) % 3 == 0, F.reverse("vids")).otherwise(F.col("vids")))
    out = topology.ensure_positive_orientation(Mesh(turned, m.points))
    return _round(measures.volume(Mesh(out, m.points)).select(KEY, "signed_volume"), "signed_volume", digits=5)


@query(f"WITH {SOUP} SELECT mesh_id, count(*) AS n_points, count(*) AS n_held, 6::BIGINT AS n_sides FROM points GROUP BY mesh_id")
def a5_box_fit(spark, d):
    """How many points each supplier's oriented box holds, and on how many of its sides one lies."""
    points = I.soup_points(spark, d)
    b = measures.obb(points)
    axis = lambda k: P.vec(*[F.get("axes", F.lit(3 * k + i)) for i in range(3)])
    at = points.join(b, KEY).withColumn("_q", P.sub(P.point(), P.vec(F.col("ox"), F.col("oy"), F.col("oz"))))
    at = at.withColumns({f"_t{k}": P.dot(F.col("_q"), axis(k)) for k in range(3)})
    held = [(F.col(f"_t{k}") >= -1e-9) & (F.col(f"_t{k}") <= F.col(f"e{k}") + 1e-9) for k in range(3)]
    sides = [F.max((F.abs(F.col(f"_t{k}") - end) <= 1e-9).cast("long")) for k in range(3) for end in (F.lit(0.0), F.col(f"e{k}"))]
    return at.groupBy(KEY).agg(F.count("*").alias("n_points"), F.count_if(held[0] & held[1] & held[2]).alias("n_held"), sum(sides[1:], sides[0]).alias("n_sides"))
