"""Registered queries over the star-schema tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.jobs import inputs as I
from tessera.jobs.report import mesh_report
from tessera.model import KEY, Mesh, fat_faces, half_edges
from tessera.sources.scratch import table as _table
from tessera.operators import clean, measures, meeting, paths, reindex, spatial, topology

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SOUP = f"""
    faces AS (
        SELECT l_suppkey AS mesh_id, l_orderkey * 8 + l_linenumber AS fid, [p % {I.VERTICES}, l_orderkey % {I.VERTICES}, (p * 7 + l_orderkey * 3 + l_linenumber) % {I.VERTICES}] AS vids
        FROM (SELECT l_suppkey, l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
    ), points AS (
        SELECT s_suppkey AS mesh_id, vid, ((vid * 37 + s_suppkey * 11) % 101) / 7.0::DOUBLE AS x, ((vid * 53 + s_suppkey * 29) % 103) / 7.0::DOUBLE AS y, ((vid * 71 + s_suppkey * 5) % 107) / 7.0::DOUBLE AS z
        FROM supplier, range({I.VERTICES}) AS r(vid)
    ), he AS (
        SELECT mesh_id, fid, i - 1 AS pos, vids[i] AS a, vids[i % 3 + 1] AS b, least(vids[i], vids[i % 3 + 1]) AS lo, greatest(vids[i], vids[i % 3 + 1]) AS hi
        FROM faces, range(1, 4) AS r(i)
    ), tri AS (
        SELECT f.mesh_id, f.fid, f.vids, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
               (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
        FROM faces f JOIN points a ON a.mesh_id = f.mesh_id AND a.vid = f.vids[1] JOIN points b ON b.mesh_id = f.mesh_id AND b.vid = f.vids[2] JOIN points c ON c.mesh_id = f.mesh_id AND c.vid = f.vids[3]
    ), ec AS (SELECT mesh_id, lo, hi, count(DISTINCT fid) AS n, min(fid) AS f0, max(fid) AS f1 FROM he GROUP BY ALL)
"""
CLOUD = """
    cloud AS (SELECT 0 AS mesh_id, p_partkey AS vid, p_size::DOUBLE AS x, p_retailprice / 100 AS y, (p_partkey % 97)::DOUBLE AS z FROM part),
    probes AS (SELECT 0 AS mesh_id, s_suppkey AS qid, (s_suppkey * 7 % 50)::DOUBLE AS x, s_suppkey * 13 % 11 + 9.5::DOUBLE AS y, (s_suppkey * 29 % 97)::DOUBLE AS z FROM supplier)
"""
TERRAIN = f"""
    points AS (SELECT 0 AS mesh_id, c_custkey AS vid, (c_custkey % {I.COLUMNS})::DOUBLE AS x, (c_custkey // {I.COLUMNS})::DOUBLE AS y, c_acctbal / 1000 AS z FROM customer),
    faces AS (
        SELECT 0 AS mesh_id, c.c_custkey * 2 + t AS fid, CASE t WHEN 0 THEN [c.c_custkey, c.c_custkey + 1, c.c_custkey + {I.COLUMNS}] ELSE [c.c_custkey + 1, c.c_custkey + {I.COLUMNS + 1}, c.c_custkey + {I.COLUMNS}] END AS vids
        FROM customer c JOIN customer d ON d.c_custkey = c.c_custkey + {I.COLUMNS + 1}, range(2) AS r(t) WHERE c.c_custkey % {I.COLUMNS} < {I.COLUMNS - 1}
    )
"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, minus zero as zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query(f"""WITH {SOUP}, q AS (SELECT mesh_id, sum(sqrt(nx * nx + ny * ny + nz * nz) / 2) AS area, sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6 AS v, count(*) AS n_faces FROM tri GROUP BY mesh_id),
    e AS (SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (n = 1) AS n_boundary, count(*) FILTER (n > 2) AS n_non_manifold FROM ec GROUP BY mesh_id)
    SELECT mesh_id, n_faces, n_edges, n_boundary, n_non_manifold, n_boundary = 0 AS is_closed, n_non_manifold = 0 AS is_manifold, round(area, 4) AS area, round(v, 4) AS signed_volume FROM q JOIN e USING (mesh_id)""")
def mesh_quality_report(spark, d):
    return _round(mesh_report(I.soup(spark, d)), "area", "signed_volume", digits=4)


@query(f"""WITH {CLOUD} SELECT mesh_id::BIGINT AS mesh_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM cloud GROUP BY mesh_id""")
def a1_aabb(spark, d):
    return measures.aabb(I.cloud(spark, d))


@query(f"""WITH {SOUP}, c AS (SELECT f.mesh_id, p.x, p.y, p.z FROM (SELECT mesh_id, unnest(vids) AS vid FROM faces) f JOIN points p USING (mesh_id, vid))
    SELECT mesh_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM c GROUP BY mesh_id""")
def a2_mesh_centroid(spark, d):
    return _round(measures.mesh_centroid(I.soup(spark, d)), "x", "y", "z")


@query(f"""WITH {CLOUD} SELECT mesh_id::BIGINT AS mesh_id, round(avg(x), 5) AS mean_x, round(avg(y), 5) AS mean_y, round(avg(z), 5) AS mean_z, round(covar_pop(x, x), 5) AS cxx, round(covar_pop(x, y), 5) AS cxy, round(covar_pop(x, z), 5) AS cxz,
    round(covar_pop(y, y), 5) AS cyy, round(covar_pop(y, z), 5) AS cyz, round(covar_pop(z, z), 5) AS czz, count(*) AS n FROM cloud GROUP BY mesh_id""")
def a3_covariance(spark, d):
    out = measures.covariance(I.cloud(spark, d))
    return _round(out, *[c for c in out.columns if c not in (KEY, "n")], digits=5)


@query(f"""WITH {SOUP}, p AS (SELECT mesh_id, vid, x, y, z, lead(x) OVER w AS u, lead(y) OVER w AS v, lead(z) OVER w AS t FROM points WINDOW w AS (PARTITION BY mesh_id ORDER BY vid))
    SELECT mesh_id, round(covar_pop(x, u), 4) AS hxx, round(covar_pop(x, v), 4) AS hxy, round(covar_pop(y, t), 4) AS hyz, round(var_pop(x) + var_pop(y) + var_pop(z), 4) AS spread, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY mesh_id""")
def a4_cross_covariance(spark, d):
    p = I.soup_points(spark, d)
    out = measures.cross_covariance(p, p.withColumn("vid", F.col("vid") - 1))
    return _round(out.select(KEY, "hxx", "hxy", "hyz", "spread", "n"), "hxx", "hxy", "hyz", "spread", digits=4)


@query()
def a5_obb(spark, d):
    out = measures.obb(I.soup_points(spark, d))
    return _round(out.select(KEY, "e0", "e1", "e2"), "e0", "e1", "e2", digits=4)


@query(f"""WITH {SOUP}, h AS (SELECT he.mesh_id, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS l FROM he JOIN points p ON p.mesh_id = he.mesh_id AND p.vid = a JOIN points q ON q.mesh_id = he.mesh_id AND q.vid = b)
    SELECT mesh_id, round(avg(l), 6) AS mean_edge, round(min(l), 6) AS min_edge, round(max(l), 6) AS max_edge FROM h GROUP BY mesh_id""")
def a8_edge_lengths(spark, d):
    return _round(measures.edge_lengths(I.soup(spark, d)), "mean_edge", "min_edge", "max_edge")


@query(f"""WITH {SOUP.replace("faces AS (", "unused AS (", 1).split("), points AS")[0]}), {TERRAIN}, tri AS (
        SELECT f.vids, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
        FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3]
    ), s AS (SELECT unnest(vids) AS vid, nx / l AS x, ny / l AS y, nz / l AS z FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM tri)),
    t AS (SELECT vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM s GROUP BY vid)
    SELECT vid, round(x / sqrt(x * x + y * y + z * z), 6) AS nx, round(y / sqrt(x * x + y * y + z * z), 6) AS ny, round(z / sqrt(x * x + y * y + z * z), 6) AS nz FROM t""")
def a9_point_normals(spark, d):
    n = measures.point_normals(I.terrain(spark, d))
    return _round(n.select("vid", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.z").alias("nz")), "nx", "ny", "nz")


@query(f"""WITH {CLOUD}, n AS (SELECT q.qid, min((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) AS d2 FROM probes q, cloud p GROUP BY q.qid)
    SELECT 0::BIGINT AS mesh_id, round(avg(sqrt(d2)), 6) AS chamfer FROM n""")
def a10_chamfer(spark, d):
    near = spatial.knn(I.cloud(spark, d), I.probes(spark, d), 1)
    return _round(measures.chamfer_error(near), "chamfer")


@query(f"""WITH {SOUP} SELECT mesh_id, fid, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area, round((ax + bx + cx) / 3, 6) AS cx, round(least(ax, bx, cx), 6) AS min_x, round(greatest(az, bz, cz), 6) AS max_z,
    CASE WHEN nx * nx + ny * ny + nz * nz > 0 THEN round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) END AS nz FROM tri""")
def p11_p14_face_measures(spark, d):
    p = F.col("pts")
    out = fat_faces(I.soup(spark, d)).select(KEY, "fid", P.area(p).alias("area"), P.centroid(p)["x"].alias("cx"), P.box_low(p)["x"].alias("min_x"), P.box_high(p)["z"].alias("max_z"), P.face_normal(p)["z"].alias("nz"))
    return _round(out, "area", "cx", "min_x", "max_z", "nz")


@query(f"""WITH {CLOUD} SELECT vid, round(-y + 3, 6) AS x, round(x - 1, 6) AS y, round(z + 2, 6) AS z FROM cloud""")
def p1_p2_transformed(spark, d):
    m = P.compose(P.translation(3, -1, 2), P.rotation((0, 0, 1), 1.5707963267948966))
    out = I.cloud(spark, d).select("vid", P.transform_point(P.point(), m).alias("p")).select("vid", "p.x", "p.y", "p.z")
    return _round(out, "x", "y", "z")


@query(f"""WITH {CLOUD}, s AS (SELECT vid, x, y, z, greatest(0, least(1, ((x - 1) * 20 + (y - 10) * 5 + (z - 2) * 30) / 1325.0)) AS t FROM cloud)
    SELECT vid, round(0.6 * x + 0.8 * z - 4, 6) AS plane, round(sqrt((x - 1 - 20 * t) ** 2 + (y - 10 - 5 * t) ** 2 + (z - 2 - 30 * t) ** 2), 6) AS segment,
           round(greatest(0, sqrt((x - 5) ** 2 + (y - 12) ** 2 + (z - 40) ** 2) - 10), 6) AS sphere, round(sqrt(greatest(0, 10 - x, x - 30) ** 2 + greatest(0, 11 - y, y - 15) ** 2 + greatest(0, 20 - z, z - 60) ** 2), 6) AS box,
           CASE WHEN 0.6 * x + 0.8 * z - 4 > 1.49e-8 THEN 'on_positive_side' WHEN 0.6 * x + 0.8 * z - 4 < -1.49e-8 THEN 'on_negative_side' ELSE 'on_boundary' END AS side FROM s""")
def p4_p7_distance_fields(spark, d):
    c, n = I.cloud(spark, d), P.vec(0.6, 0, 0.8)
    p, a, b, low, high = P.point(), P.vec(1, 10, 2), P.vec(21, 15, 32), P.vec(10, 11, 20), P.vec(30, 15, 60)
    out = measures.distance_field(c, lambda q: P.plane_distance(q, n, -4.0), "plane").select(
        "vid",
        "plane",
        P.distance(p, P.closest_on_segment(p, a, b)).alias("segment"),
        P.sphere_distance(p, P.vec(5, 12, 40), 10.0).alias("sphere"),
        P.distance(p, P.closest_in_box(p, low, high)).alias("box"),
        P.classify_plane(p, n, -4.0).alias("side"),
    )
    return _round(out, "plane", "segment", "sphere", "box")


@query(f"""WITH {SOUP}, r AS (SELECT q.mesh_id, fid, q.nx, q.ny, q.nz, ax, ay, az, (ax * nx + ay * ny + az * nz) / nullif(nz, 0) AS t FROM tri q WHERE abs(nz) > 1e-6)
    SELECT mesh_id, count(*) AS n, round(min(t), 5) AS least FROM r WHERE t >= 0.001 AND t <= 20 GROUP BY mesh_id""")
def p10_ray_planes(spark, d):
    """Rays up the z axis against the planes of faces, whose normals keep their length: a unit's rounding moves hits over the ends of the range."""
    a, b, c = (F.get("pts", F.lit(i)) for i in range(3))
    f = fat_faces(I.soup(spark, d)).withColumn("w", P.cross(P.sub(b, a), P.sub(c, a))).where(F.abs(F.col("w.z")) > 1e-6)
    met = f.withColumn("h", P.ray_plane(P.vec(0, 0, 0), P.vec(0, 0, 1), F.col("w"), -P.dot(F.col("w"), a), 0.001, 20.0))
    return _round(met.where("h.status = 'intersection'").groupBy(KEY).agg(F.count("*").alias("n"), F.min("h.t").alias("least")), "least", digits=5)


@query(f"""WITH {SOUP}, c AS (SELECT mesh_id, fid, unnest(vids) AS vid FROM faces) SELECT mesh_id, vid, count(DISTINCT fid) AS n, sum(DISTINCT fid)::BIGINT AS s FROM c GROUP BY ALL""")
def t1_face_membership(spark, d):
    m = topology.face_membership(I.soup_faces(spark, d))
    return m.select(KEY, "vid", F.size("fids").cast("long").alias("n"), F.aggregate("fids", F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@query("""WITH e AS (SELECT o_orderkey AS eid, o_custkey AS v0, o_orderkey % 4001 AS v1 FROM orders), u AS (SELECT v0 AS vid, eid FROM e UNION SELECT v1, eid FROM e)
    SELECT vid, list(eid ORDER BY eid) AS eids FROM u GROUP BY vid""")
def t2_edge_membership(spark, d):
    return topology.edge_membership(I.order_edges(spark, d)).select("vid", "eids")


@query(f"""WITH {SOUP}, l AS (SELECT mesh_id, a AS vid, b AS neighbor FROM he UNION SELECT mesh_id, b, a FROM he) SELECT * FROM l WHERE vid <> neighbor""")
def t3_vertex_link(spark, d):
    return topology.vertex_link(I.soup_faces(spark, d))


@query(f"""WITH {SOUP} SELECT DISTINCT x.mesh_id, x.fid, y.fid AS neighbor FROM he x JOIN he y ON x.mesh_id = y.mesh_id AND x.lo = y.lo AND x.hi = y.hi AND x.fid <> y.fid""")
def t4_face_link(spark, d):
    return topology.face_link(I.soup_faces(spark, d))


@query(f"""WITH {SOUP} SELECT mesh_id, fid, pos::INT AS pos, CASE WHEN n = 1 THEN 'boundary' WHEN n = 2 THEN 'manifold' WHEN fid = f0 THEN 'non_manifold_representative' ELSE 'non_manifold' END AS kind,
    CASE WHEN n = 2 THEN CASE WHEN fid = f0 THEN f1 ELSE f0 END END AS peer FROM he JOIN ec USING (mesh_id, lo, hi)""")
def t5_manifold_edge_link(spark, d):
    return topology.manifold_edge_link(I.soup_faces(spark, d))


@query(f"""WITH {TERRAIN}, e AS (SELECT vids[i] AS a, vids[i % 3 + 1] AS b FROM faces, range(1, 4) AS r(i)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    k AS (SELECT a, b, 1 AS hops FROM l UNION ALL SELECT x.a, y.b, 2 FROM l x JOIN l y ON x.b = y.a WHERE x.a <> y.b)
    SELECT a AS vid, b AS neighbor, min(hops)::INT AS hops FROM k GROUP BY a, b""")
def t6_k_rings(spark, d):
    return topology.k_rings(topology.vertex_link(I.terrain(spark, d).faces), 2).select("vid", "neighbor", "hops")


@query(f"""WITH RECURSIVE {TERRAIN}, e AS (SELECT vids[i] AS a, vids[i % 3 + 1] AS b FROM faces, range(1, 4) AS r(i)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    n(s, v) AS (SELECT vid, vid FROM points UNION SELECT n.s, l.b FROM n JOIN l ON n.v = l.a JOIN points p ON p.vid = n.s JOIN points q ON q.vid = l.b WHERE (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 6.25)
    SELECT s AS vid, v AS neighbor FROM n WHERE s <> v""")
def t7_neighborhoods(spark, d):
    m = I.terrain(spark, d)
    return topology.neighborhoods(topology.vertex_link(m.faces), m.points, 2.5).select("vid", "neighbor")


@query(f"""WITH {SOUP}, s AS (SELECT mesh_id, lo, hi, count(DISTINCT fid) AS n, min(struct_pack(f := fid, p := pos, a := a, b := b)) AS s FROM he GROUP BY ALL)
    SELECT mesh_id, s.a AS v0, s.b AS v1, n >= 3 AS many FROM s WHERE n = 1 OR n >= 3""")
def t8_t9_boundary_and_non_manifold(spark, d):
    f = I.soup_faces(spark, d)
    return topology.boundary_edges(f).withColumn("many", F.lit(False)).unionByName(topology.non_manifold_edges(f).drop("fid").withColumn("many", F.lit(True)))


@query(f"""WITH {SOUP} SELECT mesh_id, lo, hi, CASE WHEN n = 1 THEN 'boundary' ELSE 'non_manifold' END AS kind FROM ec WHERE n <> 2""")
def t10_non_simple_edges(spark, d):
    return topology.non_simple_edges(I.soup_faces(spark, d))


@query(f"""WITH {SOUP} SELECT mesh_id, bool_and(n > 1) AS is_closed, NOT bool_and(n > 1) AS is_open, bool_and(n < 3) AS is_manifold, NOT bool_and(n < 3) AS is_non_manifold FROM ec GROUP BY mesh_id""")
def t11_closedness(spark, d):
    return topology.closedness(I.soup_faces(spark, d))


def _labels_sql(before: str, nodes: str, links: str, after: str) -> str:
    """The smallest node that links (a, b, both ways) connect each of nodes (k) with, as r (k, label)."""
    return f"""WITH RECURSIVE {before}, nodes AS ({nodes}), l AS ({links}), r(k, label) USING KEY (k) AS (SELECT k, k FROM nodes UNION
    SELECT l.b, min(r.label) FROM r JOIN l ON r.k = l.a JOIN recurring.r AS w ON w.k = l.b WHERE r.label < w.label GROUP BY l.b) {after}"""


@query(_labels_sql("e AS (SELECT o_custkey AS a, o_orderkey % 4001 AS b FROM orders)", "SELECT a AS k FROM e UNION SELECT b FROM e", "SELECT a, b FROM e UNION SELECT b, a FROM e", "SELECT k AS node, label FROM r"))
def t12_connected_components(spark, d):
    from tessera.operators.graph import connected_components

    return connected_components(I.order_edges(spark, d), "v0", "v1")


def _component_sql(links: str, after: str = "SELECT k.mesh_id AS mesh_id, k.fid AS fid, label.fid AS label FROM r") -> str:
    k = "{{'mesh_id': {0}.mesh_id, 'fid': {1}}}".format
    pairs = links.format(a=k("x", "x.fid"), b=k("x", "y.fid"), f0=k("ec", "f0"), f1=k("ec", "f1"))
    return _labels_sql(SOUP, f"SELECT {k('faces', 'fid')} AS k FROM faces", pairs, after)


MANIFOLD_LINKS = "SELECT {f0} AS a, {f1} AS b FROM ec WHERE n = 2 UNION SELECT {f1}, {f0} FROM ec WHERE n = 2"


@query(_component_sql("SELECT DISTINCT {a} AS a, {b} AS b FROM he x JOIN he y ON x.mesh_id = y.mesh_id AND x.lo = y.lo AND x.hi = y.hi"))
def t13_edge_components(spark, d):
    return topology.face_components(I.soup_faces(spark, d), "edge")


@query(_component_sql(MANIFOLD_LINKS))
def t13_manifold_components(spark, d):
    return topology.face_components(I.soup_faces(spark, d), "manifold_edge")


@query(_component_sql("SELECT DISTINCT {a} AS a, {b} AS b FROM (SELECT mesh_id, fid, unnest(vids) AS v FROM faces) x JOIN (SELECT mesh_id, fid, unnest(vids) AS v FROM faces) y USING (mesh_id, v)"))
def t13_vertex_components(spark, d):
    return topology.face_components(I.soup_faces(spark, d), "vertex")


@query(_component_sql(MANIFOLD_LINKS, """, c AS (SELECT he.mesh_id, he.fid, bool_and(ec.n > 1) AS closed FROM he JOIN ec USING (mesh_id, lo, hi) GROUP BY he.mesh_id, he.fid)
    SELECT c.mesh_id, r.label.fid AS label, bool_and(c.closed) AS is_closed FROM r JOIN c ON c.mesh_id = r.k.mesh_id AND c.fid = r.k.fid GROUP BY c.mesh_id, r.label.fid"""))
def t15_component_types(spark, d):
    f = _table(I.soup_faces(spark, d))
    return topology.component_types(f, topology.face_components(f, "manifold_edge"))


@query(f"""WITH {SOUP} SELECT mesh_id, fid, fid = min(fid) OVER (PARTITION BY mesh_id, list_min([vids, [vids[2], vids[3], vids[1]], [vids[3], vids[1], vids[2]]])) AS is_first FROM faces""")
def t18_oriented_unique_faces(spark, d):
    f = I.soup_faces(spark, d).withColumn("k", topology.oriented_face_key(F.col("vids")))
    first = f.groupBy(KEY, "k").agg(F.min("fid").alias("keep"))
    return f.join(first, [KEY, "k"]).select(KEY, "fid", (F.col("fid") == F.col("keep")).alias("is_first"))


@query(_labels_sql(SOUP, "SELECT DISTINCT {'mesh_id': mesh_id, 'vid': a} AS k FROM he", "SELECT DISTINCT {'mesh_id': mesh_id, 'vid': lo} AS a, {'mesh_id': mesh_id, 'vid': hi} AS b FROM he UNION SELECT {'mesh_id': mesh_id, 'vid': hi}, {'mesh_id': mesh_id, 'vid': lo} FROM he", "SELECT k.mesh_id AS mesh_id, k.vid AS vid, label.vid AS label FROM r"))
def t14_vertex_components(spark, d):
    return topology.vertex_components(I.soup_faces(spark, d))


@query()
def t16_orient_consistently(spark, d):
    m = I.soup(spark, d)
    return topology.orient_consistently(Mesh(_table(m.faces), m.points))


@query(f"""WITH {SOUP}, k AS (SELECT mesh_id, fid, list_min([v FOR v IN [vids, [vids[2], vids[3], vids[1]], [vids[3], vids[1], vids[2]], [vids[3], vids[2], vids[1]], [vids[2], vids[1], vids[3]], [vids[1], vids[3], vids[2]]]]) AS k FROM faces)
    SELECT mesh_id, fid, fid = min(fid) OVER (PARTITION BY mesh_id, k) AS is_first FROM k""")
def t17_t18_unique_faces(spark, d):
    return topology.unique_faces_mask(I.soup_faces(spark, d))


@query("""WITH e AS (SELECT o_orderkey AS eid, o_custkey AS v0, o_orderkey % 4001 AS v1 FROM orders) SELECT x.eid, y.eid AS next_eid FROM e x JOIN e y ON x.v1 = y.v0""")
def t24_directed_edge_link(spark, d):
    return topology.directed_edge_link(I.order_edges(spark, d)).select("eid", "next_eid")


@query(f"""WITH {SOUP} SELECT mesh_id, fid, list_position(vids, 7)::INT - 1 AS at, coalesce((SELECT min(i) - 1 FROM range(1, 4) AS r(i) WHERE vids[i] = 7 AND vids[i % 3 + 1] = 8), -1)::INT AS side FROM (SELECT mesh_id, fid, vids FROM faces WHERE list_contains(vids, 7))""")
def t25_positions(spark, d):
    f = I.soup_faces(spark, d).where(F.array_contains("vids", F.lit(7).cast("long")))
    v = F.col("vids")
    return f.select(KEY, "fid", topology.vertex_position(v, F.lit(7).cast("long")).alias("at"), topology.directed_edge_position(v, F.lit(7), F.lit(8)).alias("side"))


@query(f"""WITH {CLOUD}, k AS (SELECT vid, min(vid) OVER (PARTITION BY x, round(y), z) AS new_id FROM (SELECT vid, x, y, z % 5 AS z FROM cloud)) SELECT vid AS old_id, new_id FROM k""")
def c1_clean_points(spark, d):
    p = I.cloud(spark, d).withColumns({"y": F.round("y"), "z": F.col("z") % 5})
    return clean.clean_points(p)[1].select("old_id", "new_id")


@query(f"""WITH RECURSIVE {CLOUD}, l AS (SELECT p.vid AS a, q.vid AS b FROM cloud p JOIN cloud q ON p.mesh_id = q.mesh_id AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 4.0),
    r(a, b) AS (SELECT vid, vid FROM cloud UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a) SELECT a AS old_id, min(b) AS new_id FROM r GROUP BY a""")
def c2_clean_points_tolerance(spark, d):
    return clean.point_map(I.cloud(spark, d), 2.0).select("old_id", "new_id")


@query(f"""WITH {SOUP}, good AS (SELECT mesh_id, fid, vids FROM faces WHERE len(list_distinct(vids)) = 3), k AS (SELECT mesh_id, fid, list_sort(vids) AS s FROM good),
    keep AS (SELECT mesh_id, min(fid) AS fid FROM k GROUP BY mesh_id, s) SELECT keep.mesh_id, keep.fid, vids FROM keep JOIN good USING (mesh_id, fid)""")
def c3_clean_faces(spark, d):
    m = I.soup(spark, d)
    return clean.clean_faces(Mesh(m.faces, m.points.withColumn("x", F.col("x") + F.col("vid") * 100))).mesh.faces


@query("""WITH e AS (SELECT o_orderkey AS eid, o_custkey AS v0, o_orderkey % 4001 AS v1 FROM orders WHERE o_custkey <> o_orderkey % 4001)
    SELECT min(eid) AS eid FROM e GROUP BY least(v0, v1), greatest(v0, v1)""")
def c4_clean_edges(spark, d):
    e = I.order_edges(spark, d)
    points = e.select(KEY, F.explode(F.array("v0", "v1")).alias("vid")).distinct().select(KEY, "vid", F.col("vid").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return clean.clean_edges(e, points)[0].select("eid")


@query(f"""WITH {TERRAIN}, c AS (SELECT fid, vids[i] AS vid, i - 1 AS pos FROM faces, range(1, 4) AS r(i)), n AS (SELECT vid, count(*) AS n FROM c GROUP BY vid)
    SELECT fid, pos::INT AS pos, x, y, z, n AS n_faces FROM c JOIN points USING (vid) JOIN n USING (vid)""")
def c6_weld_soup(spark, d):
    """Corners of the welded faces, and how many faces share each point."""
    m = clean.weld_soup(fat_faces(I.terrain(spark, d)).select(KEY, "fid", "pts"))
    c = m.faces.select("fid", F.posexplode("vids").alias("pos", "vid"))
    n = c.groupBy("vid").agg(F.count("*").alias("n_faces"))
    return c.join(m.points, "vid").join(n, "vid").select("fid", "pos", "x", "y", "z", "n_faces")


@query(f"""WITH {CLOUD}, k AS (SELECT vid FROM cloud WHERE x > 25) SELECT c.vid AS old_id, r.n AS new_id FROM cloud c LEFT JOIN (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS n FROM k) r USING (vid)""")
def r7_mask_map(spark, d):
    return reindex.mask_map(I.cloud(spark, d), "vid", F.col("x") > 25).select("old_id", "new_id")


@query(f"""WITH {TERRAIN}, k AS (SELECT vid FROM points WHERE z > 2) SELECT fid FROM faces WHERE len([v FOR v IN vids]) = (SELECT count(*) FROM k WHERE list_contains(vids, k.vid))""")
def r4_faces_by_points(spark, d):
    m = I.terrain(spark, d)
    return reindex.faces_by_points(m, m.points.where("z > 2")).faces.select("fid")


@query(f"""WITH {TERRAIN}, f AS (SELECT vids FROM faces WHERE fid % 3 = 0) SELECT DISTINCT unnest(vids) AS vid FROM f""")
def r2_faces_by_mask(spark, d):
    return reindex.faces_by_mask(I.terrain(spark, d), F.col("fid") % 3 == 0).points.select("vid")


@query(f"""WITH {CLOUD}, w AS (SELECT o_custkey AS vid, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT pos AS vid, x, y, z FROM w JOIN cloud USING (vid)""")
def r3_points_by_ids(spark, d):
    o = I.read(spark, d, "orders").select(F.lit(0).cast("long").alias(KEY), F.col("o_custkey").alias("vid"), "o_orderkey")
    wanted = reindex.dense_ids(o, "o_orderkey", "pos")
    return reindex.points_by_ids(I.cloud(spark, d), wanted).select("vid", "x", "y", "z")


@query(f"""WITH {TERRAIN} SELECT fid + k * 4294967296 AS fid, i - 1 AS pos, x + k * 100 AS x, y, z FROM faces, range(2) AS t(k), range(1, 4) AS r(i) JOIN points ON points.vid = faces.vids[i]""")
def r5_concatenated(spark, d):
    m = I.terrain(spark, d)
    f = fat_faces(reindex.concatenated(m, m, transforms=[None, P.translation(100, 0, 0)]))
    return f.select("fid", F.posexplode("pts").alias("pos", "p")).select("fid", F.col("pos").cast("long").alias("pos"), "p.x", "p.y", "p.z")


@query(f"""WITH {TERRAIN}, l AS (SELECT fid // 400 AS label, unnest(vids) AS v FROM faces) SELECT label, count(DISTINCT v) AS n_points FROM l GROUP BY label""")
def r6_split_by_label(spark, d):
    m = I.terrain(spark, d)
    out = reindex.split_by_label(m, m.faces.select(KEY, "fid", F.floor(F.col("fid") / 400).alias("label")))
    return out.points.groupBy(F.col(f"{KEY}.label").alias("label")).agg(F.count("*").alias("n_points"))


@query(f"""WITH {CLOUD}, s AS (SELECT q.qid, p.vid, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 AS d2 FROM probes q, cloud p), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vid) AS rank FROM s)
    SELECT qid, vid, round(d2, 6) AS d2, rank::INT AS rank FROM r WHERE rank <= 5""")
def j2_knn(spark, d):
    return _round(spatial.knn(I.cloud(spark, d), I.probes(spark, d), 5), "d2").select("qid", "vid", "d2", "rank")


@query(f"""WITH {CLOUD}, s AS (SELECT q.qid, p.vid, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 AS d2 FROM probes q, cloud p) SELECT 0::BIGINT AS mesh_id, qid, vid, round(d2, 6) AS d2 FROM s ORDER BY s.d2, qid, vid LIMIT 1""")
def j3_closest_pair(spark, d):
    return _round(spatial.closest_pair(I.cloud(spark, d), I.probes(spark, d)), "d2")


@query(f"""WITH {CLOUD} SELECT q.qid AS id0, p.vid AS id1, round((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2, 6) AS d2 FROM probes q JOIN cloud p ON (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 25""")
def j7_pairs_within(spark, d):
    return _round(spatial.pairs_within(I.probes(spark, d), I.cloud(spark, d), 5.0, "qid"), "d2").select("id0", "id1", "d2")


@query(f"""WITH {CLOUD} SELECT p.vid AS id0, q.vid AS id1 FROM cloud p JOIN cloud q ON p.vid < q.vid AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2 <= 9""")
def j8_self_pairs(spark, d):
    return spatial.self_pairs_within(I.cloud(spark, d), 3.0).select("id0", "id1")


BOXES = f"""{SOUP}, b AS (SELECT mesh_id, fid AS id, least(ax, bx, cx) AS lx, least(ay, by_, cy) AS ly, least(az, bz, cz) AS lz, least(ax, bx, cx) + (greatest(ax, bx, cx) - least(ax, bx, cx)) / 4 AS hx, least(ay, by_, cy) + (greatest(ay, by_, cy) - least(ay, by_, cy)) / 4 AS hy, least(az, bz, cz) + (greatest(az, bz, cz) - least(az, bz, cz)) / 4 AS hz FROM tri)"""


@query(f"""WITH {BOXES} SELECT x.mesh_id, x.id AS id0, y.id AS id1 FROM b x JOIN b y ON x.mesh_id = y.mesh_id AND x.id < y.id AND x.lx <= y.hx AND y.lx <= x.hx AND x.ly <= y.hy AND y.ly <= x.hy AND x.lz <= y.hz AND y.lz <= x.hz""")
def j6_box_pairs(spark, d):
    """The low corners of the faces' boxes, a quarter as long."""
    b = spatial.face_boxes(I.soup(spark, d))
    b = b.withColumn("high", P.each(lambda x, y: x + (y - x) / 4, F.col("low"), F.col("high")))
    b = _table(b)
    return meeting.self_box_pairs(b)


@query(f"""WITH {SOUP} SELECT mesh_id, round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 4) AS area FROM tri
    WHERE least(ax, bx, cx) <= 3 AND greatest(ax, bx, cx) >= 1 AND least(ay, by_, cy) <= 3 AND greatest(ay, by_, cy) >= 1 AND least(az, bz, cz) <= 3 AND greatest(az, bz, cz) >= 1 GROUP BY mesh_id""")
def j9_area_in_box(spark, d):
    p = F.col("pts")
    b = fat_faces(I.soup(spark, d)).select(KEY, "fid", P.box_low(p).alias("low"), P.box_high(p).alias("high"), P.area(p).alias("area"))
    return _round(spatial.search(b, P.vec(1, 1, 1), P.vec(3, 3, 3)).groupBy(KEY).agg(F.sum("area").alias("area")), "area", digits=4)


@query(f"""WITH {TERRAIN}, q AS (SELECT s_suppkey AS ray_id, (s_suppkey * 7 % 48) + 0.3 AS x, (s_suppkey * 13 % (SELECT max(y)::BIGINT - 1 FROM points)) + 0.2 AS y FROM supplier),
    h AS (SELECT ray_id, q.x, q.y, (q.y::BIGINT - CASE WHEN q.y::BIGINT > q.y THEN 1 ELSE 0 END) * {I.COLUMNS} + floor(q.x)::BIGINT AS v FROM q)
    SELECT ray_id, v * 2 AS fid, round(100 - (a.z + 0.3 * (b.z - a.z) + 0.2 * (c.z - a.z)), 6) AS t FROM h JOIN points a ON a.vid = v JOIN points b ON b.vid = v + 1 JOIN points c ON c.vid = v + {I.COLUMNS}""")
def j10_ray_hits(spark, d):
    m = I.terrain(spark, d)
    most = m.points.agg((F.max("y").cast("long") - 1).alias("_m"))
    s = F.col("s_suppkey")
    rays = I.read(spark, d, "supplier").join(F.broadcast(most)).select(  # one row
        F.lit(0).cast("long").alias(KEY), s.alias("ray_id"), (s * 7 % 48 + 0.3).alias("ox"), (s * 13 % F.col("_m") + 0.2).alias("oy"), F.lit(100.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(-1.0).alias("dz"), F.lit(0.0).alias("min_t"), F.lit(1e9).alias("max_t")
    )
    return _round(spatial.ray_hits(m, rays), "t").select("ray_id", "fid", "t")


@query("""WITH e AS (SELECT user_id, ts, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nv FROM events) SELECT user_id, count(*) AS n, round(sum(abs(nv - value)), 4) AS travelled FROM e WHERE nv IS NOT NULL GROUP BY user_id""")
def w1_path_steps(spark, d):
    e = paths.ordered_steps(I.read(spark, d, "events"), "user_id", ["ts", "event_id"], "value").where("next_value IS NOT NULL")
    return _round(e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("next_value") - F.col("value"))).alias("travelled")), "travelled", digits=4)


@query(f"""WITH {TERRAIN}, e AS (SELECT vids[i] AS a, vids[i % 3 + 1] AS b FROM faces, range(1, 4) AS r(i)), o AS (SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e AS x WHERE x.a = e.b AND x.b = e.a))
    SELECT a AS vid, b AS next_vid, true AS closed, (SELECT min(a) FROM o) AS path_id FROM o""")
def t20_boundary_paths(spark, d):
    """Every step of the boundary loop."""
    p = paths.boundary_paths(I.terrain(spark, d).faces)
    step = F.transform(F.sequence(F.lit(0), F.size("vids") - 2), lambda i: F.struct(F.get("vids", i).alias("vid"), F.get("vids", i + 1).alias("next_vid")))
    return p.select("closed", "path_id", F.explode(step).alias("s")).select("s.vid", "s.next_vid", "closed", "path_id")


@query()
def t19_connect_edges(spark, d):
    e = I.order_edges(spark, d)
    return paths.connect_edges(e).select("path_id", F.size("vids").alias("n"), "closed")


def _walks(spark, d):
    """Steps of the walks, each with the vertex where the next one of its walk begins."""
    at = paths.eulerian_steps(I.order_edges(spark, d))
    begins = at.select("path_id", (F.col("pos") - 1).alias("pos"), F.col("v0").alias("then"))
    return at.join(begins, ["path_id", "pos"], "left")


@query("""WITH o AS (SELECT o_custkey AS v0, o_orderkey % 4001 AS v1 FROM orders), w AS (SELECT v0 AS vid, 1 AS a, 0 AS b FROM o UNION ALL SELECT v1, 0, 1 FROM o)
    SELECT vid, sum(a)::BIGINT AS n_out, sum(b)::BIGINT AS n_in, greatest(sum(a) - sum(b), 0)::BIGINT AS n_starts, greatest(sum(b) - sum(a), 0)::BIGINT AS n_ends, 0::BIGINT AS n_breaks
    FROM w GROUP BY vid""")
def t21_eulerian_paths(spark, d):
    """By vertex: edges walked, open walks that start and end there, and steps that don't go on where they arrived."""
    at = _walks(spark, d)
    n = lambda c: F.when(c, 1).otherwise(0)
    out = F.struct(F.col("v0").alias("vid"), F.lit(1).alias("a"), F.lit(0).alias("b"), n((F.col("pos") == 0) & ~F.col("closed")).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("x"))
    to = F.struct(F.col("v1").alias("vid"), F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("s"), n(F.col("then").isNull() & ~F.col("closed")).alias("e"), n(F.col("then") != F.col("v1")).alias("x"))
    named = {"a": "n_out", "b": "n_in", "s": "n_starts", "e": "n_ends", "x": "n_breaks"}
    return at.select(F.explode(F.array(out, to)).alias("w")).groupBy("w.vid").agg(*[F.sum(f"w.{c}").alias(m) for c, m in named.items()])


@query(_labels_sql("e AS (SELECT o_custkey AS a, o_orderkey % 4001 AS b FROM orders)", "SELECT a AS k FROM e UNION SELECT b FROM e", "SELECT a, b FROM e UNION SELECT b, a FROM e",
    """, w AS (SELECT a AS k, 1 AS d FROM e UNION ALL SELECT b, -1 FROM e), x AS (SELECT k, sum(d) AS d FROM w GROUP BY k), p AS (SELECT label, sum(greatest(d, 0)) AS n FROM x JOIN r USING (k) GROUP BY label)
    SELECT sum(greatest(n, 1))::BIGINT AS n_walks, count(*) FILTER (n = 0) AS n_closed, (SELECT count(*) FROM e) AS n_edges FROM p"""))  # fmt: skip
def t21_walk_counts(spark, d):
    at = paths.eulerian_steps(I.order_edges(spark, d))
    return at.groupBy("path_id").agg(F.any_value("closed").alias("closed"), F.countDistinct("eid").alias("n")).agg(
        F.count("*").alias("n_walks"), F.count(F.when(F.col("closed"), 1)).alias("n_closed"), F.sum("n").alias("n_edges")
    )


@query(f"""WITH {TERRAIN}, e AS (SELECT DISTINCT least(vids[i], vids[i % 3 + 1]) AS lo, greatest(vids[i], vids[i % 3 + 1]) AS hi FROM faces, range(1, 4) AS r(i))
    SELECT count(*) + 1 AS n_regions, 0.0::DOUBLE AS total, count(*)::DOUBLE * 0.5 AS inner_area FROM faces""")
def t22_planar_regions(spark, d):
    m = I.terrain(spark, d)
    e = half_edges(m.faces).select(KEY, F.col("lo").alias("v0"), F.col("hi").alias("v1")).distinct().withColumn("eid", F.col("v0") * 100_000 + F.col("v1"))
    r = paths.planar_regions(e, m.points)
    return _round(r.agg(F.count("*").alias("n_regions"), F.sum("signed_area").alias("total"), F.sum(F.when(F.col("signed_area") > 0, F.col("signed_area"))).alias("inner_area")), "total", "inner_area")


@query(f"""WITH {TERRAIN}, h AS (SELECT fid, least(vids[i], vids[i % 3 + 1]) AS lo, greatest(vids[i], vids[i % 3 + 1]) AS hi FROM faces, range(1, 4) AS r(i)),
    c AS (SELECT DISTINCT lo, hi, cut, a.x + (cut - a.z) / (b.z - a.z) * (b.x - a.x) AS x, a.y + (cut - a.z) / (b.z - a.z) * (b.y - a.y) AS y FROM h JOIN points a ON a.vid = lo JOIN points b ON b.vid = hi, (VALUES (1.5), (4.5)) AS v(cut) WHERE least(a.z, b.z) < cut AND cut < greatest(a.z, b.z))
    SELECT lo, hi, cut::DOUBLE AS cut, round(x, 6) AS x, round(y, 6) AS y FROM c""")
def x1_isocontour_points(spark, d):
    from tessera.operators import contours

    m = I.terrain(spark, d)
    _, p = contours.isocontours(Mesh(m.faces, m.points.withColumn("scalar", F.col("z"))), [1.5, 4.5])
    return _round(p.select(F.col("v.lo").alias("lo"), F.col("v.hi").alias("hi"), "cut", "x", "y"), "x", "y")


CLIPPED = f"""{TERRAIN}, t AS (SELECT f.fid, a.z AS za, b.z AS zb, c.z AS zc FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3]),
    o AS (SELECT fid, list_sort([za, zb, zc]) AS z FROM t), v(cut) AS (VALUES (1.5), (4.5)),
    -- The part of a triangle below a level, as a share of its area.
    below AS (SELECT fid, cut, CASE WHEN cut <= z[1] THEN 0 WHEN cut >= z[3] THEN 1 WHEN cut <= z[2] THEN (cut - z[1]) ** 2 / ((z[2] - z[1]) * (z[3] - z[1])) ELSE 1 - (z[3] - cut) ** 2 / ((z[3] - z[1]) * (z[3] - z[2])) END AS s FROM o, v),
    w AS (SELECT fid, max(s) FILTER (cut = 1.5) AS s0, max(s) FILTER (cut = 4.5) AS s1 FROM below GROUP BY fid),
    bands AS (SELECT fid, band, CASE band WHEN 0 THEN s0 WHEN 1 THEN s1 - s0 ELSE 1 - s1 END AS share FROM w, range(3) AS r(band))"""


@query(f"""WITH {CLIPPED} SELECT fid AS src_fid, band::INT AS band, round(share * 0.5, 6) AS flat_area FROM bands WHERE share > 1e-9""")
def x2_embedded_isocurves(spark, d):
    """The area of every piece of every face, seen from above."""
    from tessera.operators import contours

    m = I.terrain(spark, d)
    flat = Mesh(m.faces, m.points.withColumns({"scalar": F.col("z"), "z": F.lit(0.0)}))
    split, labels = contours.embedded_isocurves(flat, [1.5, 4.5])
    out = measures.areas(split).join(labels, [KEY, "fid"]).select("src_fid", "band", F.col("area").alias("flat_area")).where("flat_area > 5e-10")
    return _round(out, "flat_area")


@query(f"""WITH {CLIPPED} SELECT 1 AS band, fid AS src_fid, round(share * 0.5, 6) AS flat_area FROM bands WHERE band = 1 AND share > 1e-9""")
def x3_isobands(spark, d):
    from tessera.operators import contours

    m = I.terrain(spark, d)
    split, labels = contours.isobands(Mesh(m.faces, m.points.withColumns({"scalar": F.col("z"), "z": F.lit(0.0)})), [1.5, 4.5], [1])
    return _round(measures.areas(split).join(labels, [KEY, "fid"]).select("band", "src_fid", F.col("area").alias("flat_area")).where("flat_area > 5e-10"), "flat_area")


SEGMENTS = """s AS (SELECT s_suppkey // 100 AS mesh_id, s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE AS x0, (s_suppkey * 53 % 103)::DOUBLE AS y0, (s_suppkey * 71 % 37 - 18)::DOUBLE AS dx, (s_suppkey * 29 % 41 - 20)::DOUBLE AS dy FROM supplier)"""


@query(f"""WITH {SEGMENTS}, p AS (SELECT a.mesh_id, a.id AS id0, b.id AS id1, a.dx * b.dy - a.dy * b.dx AS den, (b.x0 - a.x0) * b.dy - (b.y0 - a.y0) * b.dx AS sn, (b.x0 - a.x0) * a.dy - (b.y0 - a.y0) * a.dx AS tn, a.x0, a.y0, a.dx, a.dy FROM s a JOIN s b ON a.mesh_id = b.mesh_id AND a.id < b.id)
    SELECT mesh_id, id0, id1, round(x0 + sn / den * dx, 6) AS x, round(y0 + sn / den * dy, 6) AS y FROM p WHERE den <> 0 AND sn / den >= -1.49e-8 AND sn / den <= 1 + 1.49e-8 AND tn / den >= -1.49e-8 AND tn / den <= 1 + 1.49e-8""")
def x6_segment_crossings(spark, d):
    from tessera.operators import planar

    return _round(planar.crossings(*I.segments2d(spark, d)).select(KEY, "id0", "id1", "x", "y"), "x", "y")


@query()
def x7_planar_arrangement(spark, d):
    from tessera.operators import planar

    r = planar.planar_arrangement(*I.segments2d(spark, d))
    return _round(r.groupBy(KEY, "kind").agg(F.count("*").alias("n"), F.sum("signed_area").alias("area")), "area", digits=4)


LEVEL = 4.2371


def _flat(m: Mesh) -> Mesh:
    """Two triangles for each cell of the terrain, flat at LEVEL, off its grid and reaching beyond it."""
    return Mesh(m.faces, m.points.withColumns({"x": F.col("x") * 1.0713 - 1.317, "y": F.col("y") * 1.0717 - 1.119, "z": F.lit(LEVEL)}))


ISOLINES = f"""{TERRAIN}, h AS (SELECT f.fid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM faces f, range(1, 4) AS r(i) JOIN points a ON a.vid = f.vids[i] JOIN points b ON b.vid = f.vids[i % 3 + 1] WHERE (a.z - {LEVEL}) * (b.z - {LEVEL}) < 0),
    c AS (SELECT fid, ax + ({LEVEL} - az) / (bz - az) * (bx - ax) AS x, ay + ({LEVEL} - az) / (bz - az) * (by_ - ay) AS y FROM h)"""


@query(f"""WITH {ISOLINES} SELECT fid AS id0, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 5) AS length FROM c GROUP BY fid""")
def x4_intersection_edges(spark, d):
    """How long the intersection with a plane of many faces is in each face."""
    from tessera.operators import cut

    m = I.terrain(spark, d)
    e = cut.intersection_edges(m, _flat(m))
    return _round(e.groupBy("id0").agg(F.sum(P.distance(F.col("p"), F.col("q"))).alias("length")), "length", digits=5)


@query(f"""WITH {ISOLINES}, e AS (SELECT fid, ax, ay, bx, by_ FROM h), t AS (SELECT f.fid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3]),
    o AS (SELECT fid, list_sort([az, bz, cz]) AS z, sqrt(((by_ - ay) * (cz - az) - (bz - az) * (cy - ay)) ** 2 + ((bz - az) * (cx - ax) - (bx - ax) * (cz - az)) ** 2 + ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) ** 2) / 2 AS area FROM t),
    s AS (SELECT fid, area, CASE WHEN {LEVEL} <= z[1] THEN 0 WHEN {LEVEL} >= z[3] THEN 1 WHEN {LEVEL} <= z[2] THEN ({LEVEL} - z[1]) ** 2 / ((z[2] - z[1]) * (z[3] - z[1])) ELSE 1 - (z[3] - {LEVEL}) ** 2 / ((z[3] - z[1]) * (z[3] - z[2])) END AS below FROM o)
    SELECT fid AS src_fid, round(area * below, 4) AS below, round(area * (1 - below), 4) AS above FROM s""")
def x8_embedded_curves(spark, d):
    """The areas of each face's pieces on either side of the plane: no piece crosses it."""
    from tessera.operators import cut

    m = I.terrain(spark, d)
    split, labels = cut.embedded_curves(m, _flat(m))
    f = fat_faces(split).select(KEY, "fid", P.area(F.col("pts")).alias("area"), P.centroid(F.col("pts"))["z"].alias("z")).join(labels, [KEY, "fid"])
    side = lambda c: F.sum(F.when(c, F.col("area")).otherwise(0.0))
    return _round(f.groupBy("src_fid").agg(side(F.col("z") < LEVEL).alias("below"), side(F.col("z") >= LEVEL).alias("above")), "below", "above", digits=4)


@query(f"""WITH {TERRAIN}, e AS (SELECT least(vids[i], vids[i % 3 + 1]) AS lo, greatest(vids[i], vids[i % 3 + 1]) AS hi FROM faces, range(1, 4) AS r(i)), b AS (SELECT lo, hi FROM e GROUP BY ALL HAVING count(*) = 1)
    SELECT lo, hi, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 5) AS length FROM b JOIN points p ON p.vid = lo JOIN points q ON q.vid = hi""")
def x8_embedded_boundary(spark, d):
    """After embedding, the boundary is still the outer one and no crack has opened: its pieces, gathered by the old boundary edges."""
    from tessera.operators import cut

    m = I.terrain(spark, d)
    split, _ = cut.embedded_curves(m, _flat(m))
    at = lambda points, v, n: points.select(F.col("vid").alias(v), P.point().alias(n))
    new = topology.boundary_edges(split.faces).join(at(split.points, "v0", "p"), "v0").join(at(split.points, "v1", "q"), "v1")
    new = new.select(F.monotonically_increasing_id().alias("id"), F.lit(0).cast("long").alias(KEY), "p", "q", P.scale(P.add(F.col("p"), F.col("q")), 0.5).alias("c"))
    old = topology.boundary_edges(m.faces).join(at(m.points, "v0", "a"), "v0").join(at(m.points, "v1", "b"), "v1").select(KEY, F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"), "a", "b").withColumn("id", F.monotonically_increasing_id())
    new, old = _table(new), _table(old)
    low = lambda f, d_: P.each(lambda x, y: f(x, y) + d_, F.col("a"), F.col("b"))
    met = spatial.box_pairs(new.select(KEY, "id", F.col("c").alias("low"), F.col("c").alias("high")), old.select(KEY, "id", low(F.least, -1e-6).alias("low"), low(F.greatest, 1e-6).alias("high")))
    both = met.join(new.select(F.col("id").alias("id0"), "p", "q", "c"), "id0").join(old.select(F.col("id").alias("id1"), "lo", "hi", "a", "b"), "id1")
    both = both.where(P.distance2(F.col("c"), P.closest_on_segment(F.col("c"), F.col("a"), F.col("b"))) < 1e-12)
    out = new.join(both.select(F.col("id0").alias("id"), "lo", "hi"), "id", "left")  # a crack has no old edge
    return _round(out.groupBy("lo", "hi").agg(F.sum(P.distance(F.col("p"), F.col("q"))).alias("length")), "length", digits=5)


@query()
def x5_self_intersection_edges(spark, d):
    from tessera.operators import cut

    return cut.self_intersection_edges(I.soup(spark, d)).groupBy(KEY).agg(F.count("*").alias("n"))


def _solids(spark, d) -> tuple[Mesh, Mesh]:
    """A tetrahedron for each supplier in a mesh of its own, and another that overlaps it."""
    s = I.read(spark, d, "supplier").select(F.col("s_suppkey").alias(KEY))

    def made(o: float) -> Mesh:
        p = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("vid"), *[F.lit(float(c) + o * k).alias(a) for a, c, k in zip("xyz", q, (1.0, 0.8, 0.6), strict=True)]) for i, q in enumerate(((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)))]))
        size = 1 + F.col(KEY) % 7
        f = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("fid"), F.array(*[F.lit(v).cast("long") for v in t]).alias("vids")) for i, t in enumerate(((0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)))]))
        points = s.select(KEY, p.alias("p")).select(KEY, "p.vid", *[(F.col(f"p.{a}") * size).alias(a) for a in "xyz"])
        return Mesh(s.select(KEY, f.alias("f")).select(KEY, "f.fid", "f.vids"), points)

    return made(0.0), made(0.17)


@query("""SELECT s_suppkey AS mesh_id, round(power((1 - 0.17 * 2.4) * (1 + s_suppkey % 7), 3) / 6, 5) AS inner_volume, round((2 - power(1 - 0.17 * 2.4, 3)) * power(1 + s_suppkey % 7, 3) / 6, 5) AS union_volume FROM supplier""")
def x10_boolean_volumes(spark, d):
    from tessera.operators import cut

    a, b = _solids(spark, d)
    (inner, _), (whole, _) = cut.booleans(a, b, "intersection", "union")
    inner = measures.volume(inner).select(KEY, F.col("signed_volume").alias("inner_volume"))
    whole = measures.volume(whole).select(KEY, F.col("signed_volume").alias("union_volume"))
    return _round(inner.join(whole, KEY), "inner_volume", "union_volume", digits=5)


#: Of two similar tetrahedra one reaches into the other by its corner: what they share has three sides of the second and the slope of the first.
SIDES = """p AS (SELECT s_suppkey AS mesh_id, (1 + s_suppkey % 7) ** 2 AS w, (1 - 0.17 * 2.4) ** 2 AS k FROM supplier), a(origin, side, area) AS (SELECT * FROM (VALUES (0, 'inside', 'slope'), (0, 'outside', 'rest'), (1, 'inside', 'walls'), (1, 'outside', 'rest'))),
    s AS (SELECT mesh_id, origin, side, w * CASE WHEN origin = 0 AND side = 'inside' THEN k * sqrt(3) / 2 WHEN origin = 0 THEN 1.5 + sqrt(3) / 2 - k * sqrt(3) / 2 WHEN side = 'inside' THEN k * 1.5 ELSE 1.5 + sqrt(3) / 2 - k * 1.5 END AS area FROM p, a)"""


@query(f"""WITH {SIDES} SELECT mesh_id, origin::INT AS origin, side, round(area, 5) AS area FROM s""")
def x9_arrangement(spark, d):
    from tessera.operators import cut

    out = cut.arrangement(*_solids(spark, d)).groupBy(KEY, "origin", "side").agg(F.sum(P.area(F.col("pts"))).alias("area"))
    return _round(out, "area", digits=5)


@query(f"""WITH {SIDES} SELECT mesh_id, origin::INT AS origin, round(area, 5) AS area FROM s WHERE side = 'outside'""")
def x11_boolean_pair(spark, d):
    from tessera.operators import cut

    halves = cut.boolean_pair(*_solids(spark, d), "union")
    n = [measures.total_area(m).select(KEY, F.lit(k).alias("origin"), "area") for k, m in enumerate(halves)]
    return _round(n[0].unionByName(n[1]), "area", digits=5)


@query("""SELECT s_suppkey AS mesh_id, op, true AS is_closed, true AS is_manifold, 0::BIGINT AS n_boundary FROM supplier, (VALUES ('union'), ('intersection'), ('left_difference'), ('right_difference')) AS o(op)""")
def x10_boolean_closedness(spark, d):
    """Every result of every operation is closed and manifold."""
    from tessera.operators import cut

    out = []
    for op, (m, _) in zip(cut.KEEP, cut.booleans(*_solids(spark, d), *cut.KEEP), strict=True):
        n = topology.edge_counts(m.faces).groupBy(KEY).agg(F.count_if(F.col("n_faces") == 1).alias("n_boundary"))
        out.append(topology.closedness(m.faces).join(n, KEY).select(KEY, F.lit(op).alias("op"), "is_closed", "is_manifold", "n_boundary"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""WITH q AS (SELECT s_suppkey AS mesh_id, 1 + s_suppkey % 7 AS w FROM supplier), p AS (SELECT mesh_id, w, i, (i * 13 % 50) / 40.0 * w AS x, (i * 29 % 50) / 40.0 * w AS y, (i * 7 % 50) / 40.0 * w AS z FROM q, range(20) AS r(i))
    SELECT mesh_id, i AS qid, CASE WHEN x > 0 AND y > 0 AND z > 0 AND x + y + z < w THEN 'inside' ELSE 'outside' END AS side FROM p WHERE abs(x + y + z - w) > 1e-9 AND x > 0 AND y > 0 AND z > 0""")
def j11_points_in_mesh(spark, d):
    a, _ = _solids(spark, d)
    w = 1 + F.col(KEY) % 7
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))
    q = I.read(spark, d, "supplier").select(F.col("s_suppkey").alias(KEY), i.alias("qid"))
    q = q.select(KEY, "qid", *[(F.col("qid") * k % 50 / 40.0 * w).alias(c) for c, k in (("x", 13), ("y", 29), ("z", 7))])
    q = q.where((F.abs(F.col("x") + F.col("y") + F.col("z") - w) > 1e-9) & (F.col("x") > 0) & (F.col("y") > 0) & (F.col("z") > 0))
    return spatial.points_in_mesh(a, q)


@query(f"""WITH {TERRAIN}, e AS (SELECT vids[i] AS a, vids[i % 3 + 1] AS b FROM faces, range(1, 4) AS r(i)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), p1 AS (SELECT vid, p.x + 0.5 * (m.x - p.x) AS x, p.y + 0.5 * (m.y - p.y) AS y, p.z + 0.5 * (m.z - p.z) AS z
    FROM points p JOIN (SELECT l.a, avg(q.x) AS x, avg(q.y) AS y, avg(q.z) AS z FROM l JOIN points q ON q.vid = l.b GROUP BY l.a) m ON m.a = p.vid)
    SELECT vid, round(x + 1e-8, 6) AS x, round(y + 1e-8, 6) AS y, round(z + 1e-8, 6) AS z FROM p1""")
def g11_laplacian(spark, d):
    from tessera.operators import smoothing

    m = I.terrain(spark, d)
    out = smoothing.laplacian(m.points, topology.vertex_link(m.faces), 1)
    return _round(out.withColumns({a: F.col(a) + 1e-8 for a in P.AXES}), "x", "y", "z").select("vid", "x", "y", "z")  # off the ties


STEP = "SELECT p.vid, p.x + {w} * (m.x - p.x) AS x, p.y + {w} * (m.y - p.y) AS y, p.z + {w} * (m.z - p.z) AS z FROM {p} p JOIN (SELECT l.a, avg(q.x) AS x, avg(q.y) AS y, avg(q.z) AS z FROM l JOIN {p} q ON q.vid = l.b GROUP BY l.a) m ON m.a = p.vid"
GROW = 1 / (0.1 - 1 / 0.5)


@query(f"""WITH {TERRAIN}, e AS (SELECT vids[i] AS a, vids[i % 3 + 1] AS b FROM faces, range(1, 4) AS r(i)), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    p1 AS ({STEP.format(w=0.5, p="points")}), p2 AS ({STEP.format(w=GROW, p="p1")}), p3 AS ({STEP.format(w=0.5, p="p2")}), p4 AS ({STEP.format(w=GROW, p="p3")}) SELECT vid, round(z + 1e-8, 4) AS z FROM p4""")
def g12_taubin(spark, d):
    from tessera.operators import smoothing

    m = I.terrain(spark, d)
    out = smoothing.taubin(m.points, topology.vertex_link(m.faces), 2)
    return _round(out.withColumn("z", F.col("z") + 1e-8), "z", digits=4).select("vid", "z")


@query()
def g7_g9_shape_histogram(spark, d):
    from tessera.operators import curvature

    return measures.shape_histogram(curvature.shape_index(curvature.principal_curvatures(I.terrain(spark, d)))).drop(KEY)


def _fitted(spark, d, target, fit) -> DataFrame:
    """The cloud, moved by what fit finds between it and the target: one row a point."""
    from tessera.operators import registration

    c = I.cloud(spark, d)
    out = registration.transformed(c, fit(registration, c, target))
    return _round(out.withColumns({a: F.col(a) + 1e-9 for a in P.AXES}), *P.AXES, digits=5).select("vid", *P.AXES)  # off the ties


@query(f"""WITH {CLOUD} SELECT vid, round(0.8 * x - 0.6 * y + 3 + 1e-9, 5) AS x, round(0.6 * x + 0.8 * y + 1e-9, 5) AS y, round(z + 1e-9, 5) AS z FROM cloud""")
def g1_rigid_alignment(spark, d):
    t = P.compose(P.translation(3, 0, 0), P.rotation((0, 0, 1), 0.6435011087932844))
    moved = I.cloud(spark, d).select(KEY, "vid", P.transform_point(P.point(), t).alias("p")).select(KEY, "vid", "p.x", "p.y", "p.z")
    return _fitted(spark, d, moved, lambda r, c, q: r.fit_rigid(c, q))


@query(f"""WITH {CLOUD} SELECT vid, round(x * 2.5 + 1e-9, 5) AS x, round(y * 2.5 + 1e-9, 5) AS y, round(z * 2.5 + 1e-9, 5) AS z FROM cloud""")
def g3_similarity_alignment(spark, d):
    moved = I.cloud(spark, d).withColumns({a: F.col(a) * 2.5 for a in P.AXES})
    return _fitted(spark, d, moved, lambda r, c, q: r.fit_similarity(c, q))


SHIFTED = "WITH {cloud} SELECT vid, round(x + {by} + 1e-9, 5) AS x, round(y + 1e-9, 5) AS y, round(z + 1e-9, 5) AS z FROM cloud"


@query(SHIFTED.format(cloud=CLOUD, by=5))
def g4_obb_alignment(spark, d):
    moved = I.cloud(spark, d).withColumns({"x": F.col("x") + 5})
    return _fitted(spark, d, moved, lambda r, c, q: r.fit_obb(c, q))


@query(SHIFTED.format(cloud=CLOUD, by=0.01))
def g5_knn_alignment(spark, d):
    moved = I.cloud(spark, d).withColumns({"x": F.col("x") + 0.01})
    return _fitted(spark, d, moved, lambda r, c, q: r.fit_knn(c, q, k=1))


@query(SHIFTED.format(cloud=CLOUD, by=0.01))
def g2_point_to_plane(spark, d):
    """Normals that point every way fix all six unknowns."""

    def fit(r, c, q):
        both = c.select(KEY, "vid", P.point().alias("p")).join(q.select(KEY, "vid", P.point().alias("q")), [KEY, "vid"])
        k = F.col("vid")
        n = P.normalized(P.vec((k % 7 - 3).cast("double"), (k % 11 - 5).cast("double"), (k % 13 - 5.5).cast("double")))
        return r.fit_point_to_plane(both.select(KEY, "p", "q", n.alias("n"), F.lit(1.0).alias("w")))

    return _fitted(spark, d, I.cloud(spark, d).withColumns({"x": F.col("x") + 0.01}), fit)


@query(SHIFTED.format(cloud=CLOUD, by=0.01))
def g6_icp(spark, d):
    """Iterated alignment of the cloud with itself, moved by less than its points are apart."""

    def fit(r, c, q):
        return r.fit_icp(c, q, rounds=3, samples=2000).select(KEY, "m")

    return _fitted(spark, d, I.cloud(spark, d).withColumns({"x": F.col("x") + 0.01}), fit)


@query("""SELECT s_suppkey AS mesh_id, vid, round(((vid * 37 + s_suppkey * 11) % 101) / 7.0::DOUBLE + (s_suppkey % 7 - 3) * 0.01, 5) AS x, round(((vid * 53 + s_suppkey * 29) % 103) / 7.0::DOUBLE + (s_suppkey % 5 - 2) * 0.01, 5) AS y,
    round(((vid * 71 + s_suppkey * 5) % 107) / 7.0::DOUBLE + (s_suppkey % 3 - 1) * 0.01, 5) AS z FROM supplier, range(60) AS r(vid)""")
def g6_icp_corpus(spark, d):
    """Iterated alignment of every supplier's points with the same points under a motion of its own."""
    from tessera.operators import registration as r

    c, k = I.soup_points(spark, d), F.col(KEY)
    moves = {"x": (k % 7 - 3) * 0.01, "y": (k % 5 - 2) * 0.01, "z": (k % 3 - 1) * 0.01}
    goal = c.withColumns({a: F.col(a) + m for a, m in moves.items()})
    return _round(r.transformed(c, r.fit_icp(c, goal, rounds=2).select(KEY, "m")), "x", "y", "z", digits=5)


@query(f"""WITH {TERRAIN} SELECT fid * 4096 AS fid, fid AS src_fid FROM faces""")
def p16_triangulated(spark, d):
    from tessera.operators.triangulate import triangulated

    return triangulated(I.terrain(spark, d)).select("fid", "src_fid")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS dot, round(list_distance(a.e, b.e) ** 2, 6) AS d2 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def p3_nd_products(spark, d):
    v = I.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return _round(both.select("vec_id", P.dot_nd(F.col("e"), F.col("f")).alias("dot"), P.distance2_nd(F.col("e"), F.col("f")).alias("d2")), "dot", "d2")


@query(f"""WITH {CLOUD}, m AS (SELECT vid AS id, CASE WHEN vid % 3 <> 0 THEN vid END AS new_id FROM cloud), n AS (SELECT vid AS id, floor((x + 1) / 10)::BIGINT AS cx FROM cloud WHERE vid % 5 = 1 AND vid % 3 <> 0)
    SELECT c.vid AS id, floor(x / 10)::BIGINT AS cx FROM cloud c WHERE vid % 3 <> 0 AND vid % 5 <> 1 UNION ALL SELECT id, cx FROM n""")
def j12_index_upkeep(spark, d):
    c = I.cloud(spark, d)
    index = spatial.index_cells(spatial.point_boxes(c), 10.0)
    keep = c.select(KEY, F.col("vid").alias("old_id"), F.when(F.col("vid") % 3 != 0, F.col("vid")).alias("new_id"))
    dirty = spatial.point_boxes(c.where("vid % 5 = 1 AND vid % 3 <> 0").withColumn("x", F.col("x") + 1))
    return spatial.update_index(index, keep, dirty, 10.0).select("id", "cx")


@query(f"""WITH {TERRAIN} SELECT s_suppkey AS qid, round(min((p.x - (s_suppkey * 7 % 48)) ** 2 + (p.y - (s_suppkey * 13 % 20)) ** 2), 6) AS most FROM supplier, points p GROUP BY s_suppkey""")
def j1_nearest_vertex_in_plane(spark, d):
    flat = I.terrain_points(spark, d).withColumn("z", F.lit(0.0))
    s = F.col("s_suppkey")
    q = I.read(spark, d, "supplier").select(F.lit(0).cast("long").alias(KEY), s.alias("qid"), (s * 7 % 48).cast("double").alias("x"), (s * 13 % 20).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return _round(spatial.knn(flat, q, 1).select("qid", F.col("d2").alias("most")), "most")


@query(f"""WITH {TERRAIN}, q AS (SELECT s_suppkey AS qid, (s_suppkey * 7 % 48) + 0.3::DOUBLE AS x, (s_suppkey * 13 % 20) + 0.2::DOUBLE AS y, 4.0::DOUBLE AS z FROM supplier),
    t AS (SELECT f.fid, f.vids, (b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y) AS nx, (b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z) AS ny, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS nz
        FROM faces f JOIN points a ON a.vid = f.vids[1] JOIN points b ON b.vid = f.vids[2] JOIN points c ON c.vid = f.vids[3]),
    h AS (SELECT t.fid, nx, ny, nz, s.x AS sx, s.y AS sy, s.z AS sz, e.x - s.x AS dx, e.y - s.y AS dy, e.z - s.z AS dz FROM t, range(1, 4) AS r(i) JOIN points s ON s.vid = t.vids[i] JOIN points e ON e.vid = t.vids[i % 3 + 1]),
    g AS (SELECT qid, h.*, q.x - sx AS ux, q.y - sy AS uy, q.z - sz AS uz FROM q, h),
    k AS (SELECT *, greatest(0, least(1, (ux * dx + uy * dy + uz * dz) / (dx * dx + dy * dy + dz * dz))) AS w, (dy * uz - dz * uy) * nx + (dz * ux - dx * uz) * ny + (dx * uy - dy * ux) * nz >= 0 AS inner_side FROM g),
    d AS (SELECT qid, fid, CASE WHEN bool_and(inner_side) THEN max((ux * nx + uy * ny + uz * nz) ** 2 / (nx * nx + ny * ny + nz * nz)) ELSE min((ux - w * dx) ** 2 + (uy - w * dy) ** 2 + (uz - w * dz) ** 2) END AS d2 FROM k GROUP BY qid, fid)
    SELECT qid, round(min(d2), 6) AS d2 FROM d GROUP BY qid""")
def j1_nearest_faces(spark, d):
    m = I.terrain(spark, d)
    s = F.col("s_suppkey")
    q = I.read(spark, d, "supplier").select(F.lit(0).cast("long").alias(KEY), s.alias("qid"), (s * 7 % 48 + 0.3).alias("x"), (s * 13 % 20 + 0.2).alias("y"), F.lit(4.0).alias("z"))
    return _round(spatial.nearest_faces(m, q).select("qid", "d2"), "d2")


@query()
def c5_clean_curves(spark, d):
    e = I.order_edges(spark, d)
    p = paths.connect_edges(e).withColumn("path_id", F.col("path_id").cast("long"))
    at = e.select(KEY, F.explode(F.array("v0", "v1")).alias("vid")).distinct().select(KEY, "vid", (F.col("vid") % 500).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return clean.clean_curves(p, at)[0].select("path_id", F.size("vids").alias("n"), "closed")
