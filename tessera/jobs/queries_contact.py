"""Registered queries on exact meetings, distances and single primitives, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.jobs import inputs as I
from tessera.jobs.queries import SOUP, TERRAIN, _round, query
from tessera.model import KEY, Mesh, fat_faces
from tessera.operators import contact, reindex, topology

#: Boxes of suppliers, each in a mesh of its own: its sides are w long; a second one is moved by a part of w that differs by supplier.
MOVES = "SELECT s_suppkey AS mesh_id, 1 + s_suppkey % 7 AS w, (s_suppkey % 13) * 0.15 + 0.07 AS mx, (s_suppkey % 11) * 0.17 + 0.05 AS my, (s_suppkey % 5) * 0.29 + 0.03 AS mz FROM supplier"


def _boxes(spark, d) -> tuple[Mesh, Mesh]:
    a = I.quad_boxes(spark, d)
    k, w = F.col(KEY), 1 + F.col(KEY) % 7
    move = {"x": (k % 13) * 0.15 + 0.07, "y": (k % 11) * 0.17 + 0.05, "z": (k % 5) * 0.29 + 0.03}
    return a, Mesh(a.faces, a.points.select(KEY, "vid", *[(F.col(c) + m * w).alias(c) for c, m in move.items()]))


@query(f"""WITH m AS ({MOVES}), g AS (SELECT *, greatest(mx - 1, 0) AS gx, greatest(my - 1, 0) AS gy, greatest(mz - 1, 0) AS gz FROM m)
    SELECT mesh_id, round(w * sqrt(gx * gx + gy * gy + gz * gz), 6) AS distance FROM g""")
def j4_form_distances(spark, d):
    """How far each supplier's two boxes of quads are apart: faces against faces."""
    a, b = _boxes(spark, d)
    return _round(contact.form_distance(contact.of_faces(a), contact.of_faces(b)), "distance")


@query(f"""WITH m AS ({MOVES}), s(side, ax, bit) AS (VALUES (0, 2, 0), (1, 2, 1), (2, 1, 0), (3, 1, 1), (4, 0, 0), (5, 0, 1)), e AS (
        SELECT mesh_id, origin, side, CASE WHEN ax = 0 THEN mx * origin + bit ELSE mx * origin END AS x0, CASE WHEN ax = 0 THEN mx * origin + bit ELSE mx * origin + 1 END AS x1,
               CASE WHEN ax = 1 THEN my * origin + bit ELSE my * origin END AS y0, CASE WHEN ax = 1 THEN my * origin + bit ELSE my * origin + 1 END AS y1,
               CASE WHEN ax = 2 THEN mz * origin + bit ELSE mz * origin END AS z0, CASE WHEN ax = 2 THEN mz * origin + bit ELSE mz * origin + 1 END AS z1
        FROM m, s, (VALUES (0), (1)) AS z(origin)
    ) SELECT a.mesh_id, a.side AS id0, b.side AS id1 FROM e AS a JOIN e AS b ON a.mesh_id = b.mesh_id AND a.origin = 0 AND b.origin = 1
    WHERE a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND a.z0 <= b.z1 AND b.z0 <= a.z1""")
def j6_exact_face_pairs(spark, d):
    """The pairs of faces of each supplier's two boxes that share a point."""
    a, b = _boxes(spark, d)
    return contact.gather_pairs(contact.of_faces(a), contact.of_faces(b))


@query(f"WITH m AS ({MOVES}) SELECT mesh_id FROM m WHERE greatest(mx, my, mz) <= 1")
def j5_forms_meet(spark, d):
    a, b = _boxes(spark, d)
    return contact.forms_meet(contact.of_faces(a), contact.of_faces(b))


@query(f"""WITH {TERRAIN}, h AS (SELECT f.fid, a.z AS az, b.z AS bz, c.z AS cz FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3])
    SELECT fid AS id FROM h WHERE least(az, bz, cz) <= 4.0005 AND greatest(az, bz, cz) >= 4.0005""")
def j6_faces_at_height(spark, d):
    """The faces of the terrain that meet a level sheet, two triangles as wide as the terrain."""
    m = I.terrain(spark, d)
    ends = m.points.groupBy(KEY).agg(F.max("x").alias("x"), F.max("y").alias("y")).withColumn("z", F.lit(4.0005))
    p = [P.vec(F.lit(-1.0) if i % 2 == 0 else F.col("x") + 1, F.lit(-1.0) if i < 2 else F.col("y") + 1, F.col("z")) for i in range(4)]
    sheet = ends.select(KEY, F.lit(0).cast("long").alias("id"), F.explode(F.array(F.array(p[0], p[1], p[2]), F.array(p[1], p[3], p[2]))).alias("pts"))
    return contact.gather_ids(contact.of_faces(m), sheet).select("id")


#: Two directions at every part, from its size and key.
LINES = "SELECT p_partkey AS k, p_size::DOUBLE AS ox, p_retailprice / 100 AS oy, (p_partkey % 97)::DOUBLE AS oz, (p_partkey % 5 - 2.5)::DOUBLE AS ux, (p_partkey % 7 - 3.5)::DOUBLE AS uy, (p_partkey % 3 - 0.7)::DOUBLE AS uz FROM part"


@query(f"""WITH l AS ({LINES}), p AS (SELECT *, 20 - ox AS wx, 15 - oy AS wy, 40 - oz AS wz FROM l),
    k(kind, lo, hi) AS (VALUES ('line', -1e300, 1e300), ('ray', 0.0, 1e300), ('segment', 0.0, 1.0)),
    s AS (SELECT k, a.kind AS kind0, b.kind AS kind1, a.lo AS lo0, a.hi AS hi0, b.lo AS lo1, b.hi AS hi1, ux * ux + uy * uy + uz * uz AS uu, ux * 3 + uy * 4 + uz * 5 AS uv, 50.0 AS vv, wx * ux + wy * uy + wz * uz AS uw, wx * 3 + wy * 4 + wz * 5 AS vw, wx * wx + wy * wy + wz * wz AS ww FROM p, k AS a, k AS b),
    c AS (SELECT *, unnest([lo0, hi0, greatest(lo0, least(hi0, (uw * vv - uv * vw) / (uu * vv - uv * uv)))]) AS s0 FROM s),
    t AS (SELECT *, greatest(lo1, least(hi1, (s0 * uv - vw) / vv)) AS t0 FROM c WHERE abs(s0) < 1e200),
    e AS (SELECT *, greatest(lo0, least(hi0, (uw + t0 * uv) / uu)) AS s1 FROM t),
    f AS (SELECT *, greatest(lo1, least(hi1, (s1 * uv - vw) / vv)) AS t1 FROM e)
    SELECT k, kind0, kind1, round(sqrt(greatest(min(s1 * s1 * uu + t1 * t1 * vv + ww - 2 * s1 * t1 * uv - 2 * s1 * uw + 2 * t1 * vw), 0)), 4) AS distance FROM f GROUP BY k, kind0, kind1""")
def p5_closest_pairs(spark, d):
    """Lines, rays and segments at every part against such at one place: all nine kinds of pairs."""
    k = F.col("p_partkey")
    o = P.vec(F.col("p_size"), F.col("p_retailprice") / 100, k % 97)
    u = P.vec(k % 5 - 2.5, k % 7 - 3.5, k % 3 - 0.7)
    kinds = ("line", "ray", "segment")
    each = [F.struct(F.lit(a).alias("kind0"), F.lit(b).alias("kind1"), F.sqrt(P.closest_of_lines(a, o, u, b, P.vec(20, 15, 40), P.vec(3, 4, 5))["d2"]).alias("distance")) for a in kinds for b in kinds]
    return _round(I.dealt(I.read(spark, d, "part"), "p_partkey").select(k.alias("k"), F.explode(F.array(*each)).alias("e")).select("k", "e.*"), "distance", digits=4)


@query("""WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE - 25 AS x, p_retailprice / 100 - 14 AS y FROM part), g AS (SELECT k, x, y, (x > 1 OR x < -20 OR y > 1 OR y < -3) AS out_l, x > -5 AND y > -1 AS notch FROM p)
    SELECT k, CASE WHEN x > -20 AND x < 1 AND y > -3 AND y < 1 AND NOT (x > -5 AND y > -1) THEN 'inside'
        WHEN x >= -20 AND x <= 1 AND y >= -3 AND y <= 1 AND NOT (x > -5 AND y > -1) THEN 'on_boundary' ELSE 'outside' END AS side,
        CASE WHEN x = 0 AND y >= 0 OR y = 0 AND x >= 0 THEN 'on_boundary' WHEN x > 0 AND y > 0 THEN 'on_positive_side' ELSE 'on_negative_side' END AS wedge,
        CASE WHEN y = 0 AND x >= 0 AND x <= 9 THEN 'on_boundary' WHEN y = 0 THEN 'on_negative_side' WHEN y > 0 THEN 'on_positive_side' ELSE 'on_negative_side' END AS segment FROM g""")
def p7_p8_sides(spark, d):
    """Each part's place against an L in a tilted plane, a wedge of a quarter turn and a segment."""
    x, y = F.col("p_size") - 25.0, F.col("p_retailprice") / 100 - 14
    ell = F.array(*[P.vec(a, b, float(a + 2 * b)) for a, b in ((-20, -3), (1, -3), (1, -1), (-5, -1), (-5, 1), (-20, 1))])
    flat = P.vec(x, y)
    return I.dealt(I.read(spark, d, "part"), "p_partkey").select(
        F.col("p_partkey").alias("k"),
        P.point_in_polygon(P.vec(x, y, x + 2 * y), ell).alias("side"),
        P.classify_wedge2d(flat, P.vec(0, 0), P.vec(1, 0), P.vec(0, 1)).alias("wedge"),
        P.classify_segment2d(flat, P.vec(0, 0), P.vec(9, 0)).alias("segment"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice / 100 AS y, (p_partkey % 97)::DOUBLE AS z FROM part), g AS (SELECT *, greatest(10 - x, x - 30, 0) AS gx, greatest(12 - y, y - 16, 0) AS gy, z - 50 AS gz FROM p)
    SELECT k, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS polygon, round(sqrt(greatest(10 - x, x - 30, 0) ** 2 + greatest(12 - y, y - 16, 0) ** 2 + greatest(40 - z - 5, z - 60, 0) ** 2), 6) AS segment FROM g""")
def p4_polygon_and_box_distances(spark, d):
    """From each part to a flat rectangle, and from an upright segment of length 5 on it to a box."""
    k = F.col("p_partkey")
    p = P.vec(F.col("p_size"), F.col("p_retailprice") / 100, k % 97)
    flat = F.array(*[P.vec(a, b, 50) for a, b in ((10, 12), (30, 12), (30, 16), (10, 16))])
    out = I.dealt(I.read(spark, d, "part"), "p_partkey").select(k.alias("k"), P.let(P.closest_in_polygon(p, flat), lambda q: P.distance(p, q)).alias("polygon"), F.sqrt(P.segment_box_distance2(p, P.add(p, P.vec(0, 0, 5)), P.vec(10, 12, 40), P.vec(30, 16, 60))).alias("segment"))
    return _round(out, "polygon", "segment")


@query(f"""WITH RECURSIVE {TERRAIN}, t AS (SELECT f.fid, f.vids, -(b.z - a.z) * (c.y - a.y) + (b.y - a.y) * (c.z - a.z) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
        FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3]),
    h AS (SELECT fid, least(vids[i], vids[i % 3 + 1]) AS lo, greatest(vids[i], vids[i % 3 + 1]) AS hi FROM faces, range(1, 4) AS r(i)),
    l AS (SELECT x.fid AS a, y.fid AS b FROM h x JOIN h y ON x.lo = y.lo AND x.hi = y.hi AND x.fid <> y.fid JOIN t u ON u.fid = x.fid JOIN t v ON v.fid = y.fid
        WHERE u.nx * v.nx + u.ny * v.ny + u.nz * v.nz > 0.8 * sqrt((u.nx * u.nx + u.ny * u.ny + u.nz * u.nz) * (v.nx * v.nx + v.ny * v.ny + v.nz * v.nz))),
    r(k, label) USING KEY (k) AS (SELECT fid, fid FROM t UNION SELECT l.b, min(r.label) FROM r JOIN l ON r.k = l.a JOIN recurring.r AS w ON w.k = l.b WHERE r.label < w.label GROUP BY l.b)
    SELECT k AS fid, label FROM r""")
def t14_smooth_components(spark, d):
    """Faces of the terrain that are connected over sides at which the normals turn little."""
    m = I.terrain(spark, d)
    n = fat_faces(m).select(KEY, "fid", P.normalized(P.newell(F.col("pts"))).alias("n"))
    pairs = topology.face_link(m.faces).join(n, [KEY, "fid"]).join(n.select(KEY, F.col("fid").alias("neighbor"), F.col("n").alias("m")), [KEY, "neighbor"])
    return topology.components_where(pairs, m.faces.select(KEY, "fid"), P.dot(F.col("n"), F.col("m")) > 0.8).select("fid", "label")


@query("""SELECT c_custkey % 100 AS mesh_id, min(c_custkey) AS vid, round(arg_min(c_acctbal, c_custkey), 2) AS z, count(*) AS n FROM customer GROUP BY c_custkey % 100""")
def r1_reindexed(spark, d):
    """Customers' places under a map to the first of their hundredth: points move to new ids, equal ones once."""
    c = F.col("c_custkey")
    points = I.read(spark, d, "customer").select((c % 100).alias(KEY), c.alias("vid"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("c_acctbal").alias("z"))
    first = points.groupBy(KEY).agg(F.min("vid").alias("new_id"), F.count("*").alias("n"))
    index_map = points.select(KEY, F.col("vid").alias("old_id")).join(first.drop("n"), KEY)
    out = reindex.reindexed(points, index_map, "vid")
    return _round(out.join(first.drop("new_id"), KEY).select(KEY, "vid", "z", "n"), "z", digits=2)
