import math

import numpy as np
import pytest
from meshes import APART, BOOK, HOLE, HOUSE, MIXED, OCTA, TURNED, mesh
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import Mesh
from tessera.operators import clean, contours, curvature, cut, measures, paths, planar, registration, reindex, smoothing, spatial, topology
from tessera.operators.graph import chains, connected_components
from tessera.operators.triangulate import triangulated
from tessera.sources import files, generate


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_boundaries(spark):
    house = mesh(spark, *HOUSE).faces
    assert {tuple(sorted(r[1:])) for r in rows(topology.boundary_edges(house))} == {(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)}
    assert topology.boundary_edges(mesh(spark, *OCTA).faces).count() == 0
    assert rows(topology.non_manifold_edges(mesh(spark, *BOOK).faces)) == [(0, 0, 1, 0)]
    assert tuple(topology.closedness(mesh(spark, *OCTA).faces).first())[1:] == (True, False, True, False)


def test_measures(spark):
    assert measures.volume(mesh(spark, *OCTA)).first().signed_volume == pytest.approx(4 / 3)
    assert measures.total_area(mesh(spark, *HOLE)).first().area == pytest.approx(3)
    assert measures.total_area(mesh(spark, *HOUSE)).first().area == pytest.approx(9)
    b = measures.obb(generate.box(spark, 4, 2, 1).points).first()
    assert [round(b[k], 6) for k in ("e0", "e1", "e2")] == [4, 2, 1]


def test_components_and_orientation(spark):
    assert {r.label for r in topology.face_components(mesh(spark, *APART).faces).collect()} == {0, 1}
    out = topology.orient_consistently(mesh(spark, *TURNED))
    sides = [(a, b) for r in out.collect() for a, b in zip(r.vids, r.vids[1:] + r.vids[:1])]
    assert len(set(sides)) == 9
    m = generate.box(spark, 1, 1, 1)
    inside_out = Mesh(topology.reverse_winding(m.faces), m.points)
    assert measures.volume(Mesh(topology.ensure_positive_orientation(inside_out), m.points)).first().signed_volume == pytest.approx(1)


def test_graph_chain_and_ring(spark):
    links = spark.createDataFrame([(i, i + 1 if i < 9 else None) for i in range(10)] + [(20, 21), (21, 22), (22, 20)], "item long, next long")
    got = {r.item: (r.label, r.pos, r.closed) for r in chains(links).collect()}
    assert all(got[i] == (0, i, False) for i in range(10))
    assert [got[i] for i in (20, 21, 22)] == [(20, 0, True), (20, 1, True), (20, 2, True)]
    line = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(line).select("label").distinct().collect()[0].label == 0


def test_paths(spark):
    e = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 2), (0, 2, 1, 3), (0, 3, 3, 4)], "mesh_id long, eid long, v0 long, v1 long")
    got = {tuple(r.vids) if r.vids[0] < r.vids[-1] else tuple(r.vids[::-1]) for r in paths.connect_edges(e).collect()}
    assert got == {(0, 1), (1, 2), (1, 3, 4)}
    loops = paths.boundary_paths(mesh(spark, *HOLE).faces).collect()
    assert sorted(len(r.vids) for r in loops) == [5, 5] and all(r.closed and r.vids[0] == r.vids[-1] for r in loops)
    pinch = [(0, 1, 2), (0, 3, 4)]
    p = mesh(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (-1, 0, 0), (-1, -1, 0)], pinch)
    used = [s for r in paths.boundary_paths(p.faces).collect() for s in zip(r.vids, r.vids[1:])]
    assert sorted(used) == [(0, 1), (0, 3), (1, 2), (2, 0), (3, 4), (4, 0)]


def test_clean(spark):
    """A random mesh with copied and slightly moved points, faces that become equal and faces that shrink, against plain Python."""
    rng = np.random.default_rng(6)
    for tolerance in (0.0, 0.01):
        base = rng.integers(0, 50, (40, 3)).astype(float)
        copies = rng.integers(0, 40, 30)
        pts = np.concatenate([base, base[copies] + (rng.uniform(-0.002, 0.002, (30, 3)) if tolerance else 0)])
        faces = [tuple(map(int, rng.choice(70, 3, replace=False))) for _ in range(120)]
        faces += [(f[1], f[2], f[0]) for f in faces[:10]] + [(f[2], f[1], f[0]) for f in faces[10:20]]
        place, name = {}, []
        for p in pts:
            name.append(place.setdefault(tuple(np.round(p)), len(name)))
        want, seen = {}, {}
        for i, f in enumerate(faces):
            g = [name[v] for v in f]
            if len(set(g)) == 3:
                want[i] = seen.setdefault(tuple(sorted(g)), i)
        c = clean.clean_faces(mesh(spark, pts.tolist(), faces), tolerance)
        kept = {r.fid: r.vids for r in c.mesh.faces.collect()}
        assert set(kept) == set(want.values()) and all(v == [name[x] for x in faces[i]] for i, v in kept.items())
        assert {r.old_id: r.new_id for r in c.face_map.collect()} == {i: want.get(i) for i in range(len(faces))}
        used = {v for f in kept.values() for v in f}
        assert {r.vid for r in c.mesh.points.collect()} == used
        assert {r.old_id: r.new_id for r in c.point_map.collect()} == {i: n if n in used else None for i, n in enumerate(name)}
    masks = topology.unique_faces_mask(mesh(spark, HOUSE[0], [(4, 2, 3), (2, 3, 4), (3, 2, 4), (0, 1, 2)]).faces)
    assert [r.is_first for r in masks.orderBy("fid").collect()] == [True, False, False, True]


def test_triangulate(spark):
    assert triangulated(mesh(spark, *MIXED)).count() == 4
    star = [(0, 0, 0), (4, 0, 0), (4, 4, 0), (2, 1, 0), (0, 4, 0)]
    m = mesh(spark, star, [(0, 1, 2, 3, 4)])
    t = triangulated(m)
    assert measures.total_area(Mesh(t.drop("src_fid"), m.points)).first().area == pytest.approx(measures.total_area(m).first().area)
    assert t.count() == 3


def test_primitives(spark):
    a, b, c = P.vec(0, 0, 0), P.vec(1, 0, 0), P.vec(0, 1, 0)
    rng = np.random.default_rng(1)
    grid = [(u, v) for u in np.linspace(0, 1, 60) for v in np.linspace(0, 1 - u, 60)]
    for p in rng.normal(size=(6, 3)) * 2:
        best = min((p[0] - u) ** 2 + (p[1] - v) ** 2 + p[2] ** 2 for u, v in grid)
        got = value(spark, P.distance2(P.vec(*p), P.closest_on_triangle(P.vec(*p), a, b, c)))
        assert got <= best + 1e-9 and got == pytest.approx(best, abs=0.05)
    hit = value(spark, P.ray_triangle(P.vec(0.2, 0.2, 1), P.vec(0, 0, -1), a, b, c))
    assert hit.status == "intersection" and hit.t == pytest.approx(1)
    assert value(spark, P.ray_box(P.vec(-1, 0.5, 0.5), P.vec(1, 0, 0), P.vec(0, 0, 0), P.vec(1, 1, 1))).t == pytest.approx(1)
    square = F.array(P.vec(0, 0), P.vec(1, 0), P.vec(1, 1), P.vec(0, 1))
    assert [value(spark, P.point_in_polygon2d(P.vec(*p), square)) for p in ((0.5, 0.5), (2, 0.5), (1, 0.5))] == ["inside", "outside", "on_boundary"]
    assert value(spark, P.classify_segment2d(P.vec(2, 0), P.vec(0, 0), P.vec(1, 0))) == "on_negative_side"
    s = value(spark, P.closest_of_segments(P.vec(0, 0, 0), P.vec(1, 0, 0), P.vec(0.5, 1, 1), P.vec(0.5, -1, 1)))
    assert s.d2 == pytest.approx(1)
    turn = P.rotation_between((1, 0, 0), (0, 0, 1))
    assert np.allclose(np.reshape(turn, (4, 4))[:3, :3] @ [1, 0, 0], [0, 0, 1])


def _cloud(spark, p, name="vid"):
    return spark.createDataFrame([(0, i, *map(float, q)) for i, q in enumerate(p)], f"mesh_id long, {name} long, x double, y double, z double")


def test_knn_and_pairs_match_brute_force(spark):
    rng = np.random.default_rng(3)
    p, q = rng.random((300, 3)), rng.random((20, 3)) * 1.5
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    got = {(r.qid, r["rank"]): r.vid for r in spatial.knn(_cloud(spark, p), _cloud(spark, q, "qid"), 4).collect()}
    assert got == {(i, k + 1): int(v) for i in range(20) for k, v in enumerate(d2[i].argsort(kind="stable")[:4])}
    near = spatial.pairs_within(_cloud(spark, q), _cloud(spark, p), 0.2)
    assert {(r.id0, r.id1) for r in near.collect()} == {(int(a), int(b)) for a, b in zip(*np.nonzero(d2 <= 0.04))}
    few = spatial.knn(_cloud(spark, p), _cloud(spark, q, "qid"), 4, radius=0.1)
    assert few.count() == sum(min(4, int((r <= 0.01).sum())) for r in d2)


def test_rays_and_inside(spark):
    m = generate.sphere(spark, 1.0, 12, 16)
    rays = spark.createDataFrame([(0, 0, 0.01, 0.02, 5.0, 0.0, 0.0, -1.0, 0.0, 100.0), (0, 1, 3.0, 0.0, 5.0, 0.0, 0.0, -1.0, 0.0, 100.0)], "mesh_id long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, min_t double, max_t double")
    hits = spatial.ray_hits(m, rays).collect()
    assert [r.ray_id for r in hits] == [0] and hits[0].t == pytest.approx(4, abs=0.05)
    p = np.random.default_rng(4).uniform(-1.2, 1.2, (60, 3))
    r = np.linalg.norm(p, axis=1)
    side = {x.qid: x.side for x in spatial.points_in_mesh(m, _cloud(spark, p, "qid")).collect()}
    assert all(side[i] == "inside" for i in range(60) if r[i] < 0.93) and all(side[i] == "outside" for i in range(60) if r[i] > 1)


def test_registration(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(120, 3)) * [3, 2, 1] + [0.2 * i for i in range(3)]
    p[:, 0] += 0.3 * p[:, 1] ** 2
    m = np.reshape(P.compose(P.translation(1, 2, 3), P.rotation((1, 2, 3), 0.4)), (4, 4))
    q = p @ m[:3, :3].T + m[:3, 3]
    a, b = _cloud(spark, p), _cloud(spark, q)
    assert np.allclose(np.reshape(registration.fit_rigid(a, b).first().m, (4, 4)), m, atol=1e-8)
    s = np.reshape(registration.fit_similarity(a, _cloud(spark, 2.5 * q)).first().m, (4, 4))
    assert np.linalg.det(s[:3, :3]) ** (1 / 3) == pytest.approx(2.5)
    box = np.reshape(registration.fit_obb(a, b).first().m, (4, 4))
    assert np.allclose(box, m, atol=1e-6)
    small = np.reshape(P.compose(P.translation(0.05, 0.02, 0), P.rotation((0, 0, 1), 0.03)), (4, 4))
    moved = p @ small[:3, :3].T + small[:3, 3]
    got = np.reshape(registration.fit_icp(a, _cloud(spark, moved), rounds=15).first().m, (4, 4))
    assert np.abs(p @ got[:3, :3].T + got[:3, 3] - moved).max() < 0.05
    pairs = spark.createDataFrame([(0, *x, *y, *n) for x, y, n in zip(p.tolist(), moved.tolist(), rng.normal(size=(120, 3)).tolist())], "mesh_id long, a double, b double, c double, d double, e double, f double, g double, h double, i double")
    v = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, "xyz")])
    pl = registration.fit_point_to_plane(pairs.select("mesh_id", v("a", "b", "c").alias("p"), v("d", "e", "f").alias("q"), v("g", "h", "i").alias("n"), F.lit(1.0).alias("w")))
    assert np.allclose(np.reshape(pl.first().m, (4, 4)), small, atol=5e-3)


def test_curvature_and_smoothing(spark):
    m = generate.sphere(spark, 2.0, 20, 20)
    k = curvature.shape_index(curvature.principal_curvatures(m)).join(m.points, ["mesh_id", "vid"]).where("abs(z) < 1.2").collect()
    assert k and all(abs(abs(r.k0) - 0.5) < 0.06 and abs(abs(r.k1) - 0.5) < 0.06 for r in k)
    link = topology.vertex_link(m.faces)
    r = lambda p: p.agg(F.avg(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))).first()[0]
    flat, round_ = r(smoothing.laplacian(m.points, link, 4)), r(smoothing.taubin(m.points, link, 4))
    assert flat < round_ <= 2.02
    two = topology.k_rings(link, 1)
    assert rows(two.select("mesh_id", "vid", "neighbor")) == rows(link)


def test_contours(spark):
    m = generate.sphere(spark, 1.0, 20, 24)
    field = Mesh(m.faces, m.points.withColumn("scalar", F.col("z")))
    edges, points = contours.isocontours(field, [0.41])
    p = points.collect()
    assert all(abs(x.z - 0.41) < 1e-9 and abs(x.x**2 + x.y**2 - (1 - 0.41**2)) < 0.03 for x in p)
    found = contours.isocontour_paths(field, [0.41]).collect()
    assert len(found) == 1 and found[0].closed and edges.count() == len(found[0].vids) - 1
    split, labels = contours.embedded_isocurves(field, [-0.3, 0.41])
    assert measures.total_area(split).first().area == pytest.approx(measures.total_area(m).first().area)
    assert topology.closedness(split.faces).first().is_closed and {r.band for r in labels.select("band").distinct().collect()} == {0, 1, 2}
    band, _ = contours.isobands(field, [-0.3, 0.41], [1])
    assert 0 < measures.total_area(band).first().area < measures.total_area(m).first().area


def test_planar_arrangement(spark):
    e = spark.createDataFrame([(0, i, 2 * i, 2 * i + 1) for i in range(4)], "mesh_id long, eid long, v0 long, v1 long")
    p = _cloud(spark, [(0, 1, 0), (3, 1, 0), (0, 2, 0), (3, 2, 0), (1, 0, 0), (1, 3, 0), (2, 0, 0), (2, 3, 0)])
    assert planar.crossings(e, p).count() == 4
    faces = planar.planar_arrangement(e, p).where("kind = 'face'").collect()
    assert len(faces) == 1 and faces[0].signed_area == pytest.approx(1)
    square = lambda a, b: [(a, a, 0), (b, a, 0), (b, b, 0), (a, b, 0)]
    nested = _cloud(spark, square(0, 9) + square(1, 8) + square(2, 3))
    rings = spark.createDataFrame([(0, 4 * k + i, 4 * k + i, 4 * k + (i + 1) % 4) for k in range(3) for i in range(4)], "mesh_id long, eid long, v0 long, v1 long")
    got = paths.planar_embedding(rings, nested).collect()
    area = {r.region: r.signed_area for r in got}
    assert sorted((r.signed_area, area.get(r.parent)) for r in got if r.kind == "hole") == [(-49.0, 81.0), (-1.0, 49.0)]


def test_intersections_and_booleans(spark):
    a, b = generate.box(spark, 2, 2, 2), generate.box(spark, 2, 2, 2)
    b = Mesh(b.faces, b.points.withColumns({c: F.col(c) + d for c, d in zip("xyz", (0.9, 0.7, 0.6))}))
    inner = 1.1 * 1.3 * 1.4
    for op, want in (("union", 16 - inner), ("intersection", inner), ("left_difference", 8 - inner)):
        got, labels = cut.boolean(a, b, op)
        assert measures.volume(got).first().signed_volume == pytest.approx(want, rel=1e-6), op
        assert {r.origin for r in labels.select("origin").distinct().collect()} == {0, 1}
    split, _ = cut.embedded_curves(a, b)
    assert measures.total_area(split).first().area == pytest.approx(24)
    curve = cut.intersection_curves(a, b).collect()
    assert len(curve) == 1 and curve[0].closed
    both = reindex.concatenated(a, b)
    assert cut.self_intersection_edges(both).count() == cut.intersection_edges(a, b).count()
    big, small = generate.sphere(spark, 2, 10, 12), generate.sphere(spark, 1, 10, 12)
    shell, _ = cut.boolean(big, small, "left_difference")
    assert measures.volume(shell).first().signed_volume == pytest.approx(measures.volume(big).first().volume - measures.volume(small).first().volume)


def test_generators_and_files(spark, tmp_path):
    for m, n_points, n_faces, volume in ((generate.box(spark, 1, 2, 3), 8, 12, 6), (generate.box_grid(spark, 1, 2, 3, 3), 56, 108, 6), (generate.cylinder(spark, 1, 2, 32), 66, 128, None)):
        assert (m.points.count(), m.faces.count()) == (n_points, n_faces)
        assert topology.closedness(m.faces).first().is_closed
        v = measures.volume(m).first().signed_volume
        assert v == pytest.approx(volume) if volume else v == pytest.approx(32 / 2 * math.sin(2 * math.pi / 32) * 2)
    s = generate.sphere(spark, 1, 5, 7)
    assert s.points.count() == 2 + 4 * 7 and s.faces.count() == 2 * 7 * 4 and measures.volume(s).first().signed_volume > 0
    assert measures.total_area(generate.plane(spark, 2, 3, 4, 5)).first().area == pytest.approx(6)
    box = generate.box(spark, 1, 1, 1)
    (tmp_path / "a.stl").write_bytes(bytes(files.stl_files(box).first().content))
    files.write_lines(files.obj_lines(box), str(tmp_path / "obj"))
    files.write_lines(files.stl_lines(box), str(tmp_path / "stl"))
    stl, obj = files.read_stl(spark, str(tmp_path / "a.stl")), files.read_obj(spark, str(tmp_path / "obj/*/*.txt"))
    for m in (stl, obj, files.read_stl(spark, str(tmp_path / "stl/*/*.txt"))):
        assert m.points.count() == 8 and measures.volume(m).first().signed_volume == pytest.approx(1)
    text = b"solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid t\n"
    assert files.parse_stl(text).shape == (1, 3, 3)


def test_reindex_and_index_upkeep(spark):
    from tessera.streaming.incremental import index_updater

    p = _cloud(spark, np.arange(30).reshape(10, 3))
    m = reindex.mask_map(p, "vid", F.col("vid") % 2 == 1)
    assert {r.old_id: r.new_id for r in m.collect()} == {i: (i // 2 if i % 2 else None) for i in range(10)}
    assert sorted(r.vid for r in reindex.reindexed(p, m, "vid").collect()) == list(range(5))
    again = reindex.chained(m, reindex.inverted(m))
    assert {r.old_id: r.new_id for r in again.collect()} == {i: (i if i % 2 else None) for i in range(10)}
    kept = {}
    state = {"i": spatial.index_cells(spatial.point_boxes(p), 4.0)}
    apply = index_updater(lambda: state["i"], lambda df: state.update(i=df), 4.0)
    change = spatial.point_boxes(_cloud(spark, [(0, 0, 0), (9, 9, 9)])).withColumns({"removed": F.col("id") == 1, "seq": F.lit(1)})
    apply(change, 0)
    apply(change, 0)
    kept = {(r.id, r.cx) for r in state["i"].collect()}
    assert 1 not in {i for i, _ in kept} and (0, 0) in kept and len(kept) == 9


def test_null_and_empty(spark):
    empty = Mesh(mesh(spark, *HOUSE).faces.limit(0), mesh(spark, *HOUSE).points.limit(0))
    assert topology.boundary_edges(empty.faces).count() == 0
    assert clean.clean_faces(empty).mesh.faces.count() == 0
    assert paths.boundary_paths(empty.faces).count() == 0
    assert spatial.knn(_cloud(spark, [(0, 0, 0)]).limit(0), _cloud(spark, [(0, 0, 0)], "qid")).count() == 0
