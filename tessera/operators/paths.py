"""Paths, loops and planar regions from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY
from tessera.operators.graph import chains, spanning_forest
from tessera.operators.reindex import dense_ids
from tessera.operators.topology import boundary_edges
from tessera.sources.scratch import table


def _gather(placed: DataFrame) -> DataFrame:
    """paths from placed darts (mesh_id, label, pos, closed, v0, v1): the starts in order, then the last end."""
    p = placed.groupBy(KEY, "label").agg(F.sort_array(F.collect_list(F.struct("pos", "v0", "v1"))).alias("c"), F.first("closed").alias("closed"))
    return p.select(KEY, F.col("label").alias("path_id"), F.concat(F.col("c.v0"), F.array(F.element_at(F.col("c.v1"), -1))).alias("vids"), "closed")


def _darts(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: dart 2 * eid runs v0 to v1, 2 * eid + 1 back."""
    both = F.explode(F.array(F.struct((F.col("eid") * 2).alias("d"), F.col("v0").alias("u"), F.col("v1").alias("v")), F.struct((F.col("eid") * 2 + 1).alias("d"), F.col("v1").alias("u"), F.col("v0").alias("v"))))
    return edges.select(KEY, both.alias("e")).select(KEY, "e.d", "e.u", "e.v")


def connect_edges(edges: DataFrame) -> DataFrame:
    """paths through undirected edges: they break at vertices of degree other than 2; closed loops repeat their first vertex.

    Equal edges count once and loops from a vertex to itself not at all. A path
    runs as its edge of the smallest id does.
    """
    e = edges.where("v0 <> v1").withColumns({"lo": F.least("v0", "v1"), "hi": F.greatest("v0", "v1")})
    e = e.groupBy(KEY, "lo", "hi").agg(F.min(F.struct("eid", "v0", "v1")).alias("e")).select(KEY, "e.eid", "e.v0", "e.v1")
    d = table(_darts(e))
    through = d.groupBy(KEY, "u").agg(F.count("*").alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1")).where("n = 2")
    nxt = d.join(through.select(KEY, F.col("u").alias("v"), "d0", "d1"), [KEY, "v"], "left")
    # The other dart that leaves v: not this one's reverse.
    back = F.col("d").bitwiseXOR(F.lit(1))
    to = F.when(F.col("d0") == back, F.col("d1")).otherwise(F.col("d0"))
    links = nxt.select(F.struct(KEY, F.col("d").alias("id")).alias("item"), F.when(to.isNotNull(), F.struct(F.col(KEY), to.alias("id"))).alias("next"))
    placed = chains(links)
    one_way = placed.where("label.id % 2 = 0")
    out = one_way.select(F.col(f"item.{KEY}").alias(KEY), F.col("item.id").alias("d"), F.col("label.id").alias("label"), "pos", "closed").join(d, [KEY, "d"])
    return _gather(out.withColumnsRenamed({"u": "v0", "v": "v1"}))


def _numbered(rows: DataFrame, key: list[str], order: str, name: str) -> DataFrame:
    """rows with a number from 0 on within each key, in order; no key has to fit one task."""
    keyed = rows.withColumnRenamed(KEY, "_mesh").withColumn(KEY, F.struct(*["_mesh" if c == KEY else c for c in key]))
    return dense_ids(keyed, order, name).drop(KEY).withColumnRenamed("_mesh", KEY)


def eulerian_steps(edges: DataFrame) -> DataFrame:
    """Directed edges (mesh_id, eid, v0, v1) placed on the fewest edge-disjoint walks that use each once: mesh_id, eid, v0, v1, path_id, pos, closed.

    Arriving and leaving edges are paired by number at each vertex; those left
    over begin or end a walk there. This makes open walks, as few as there can
    be, and circuits. Circuits and the vertices they pass, with one open walk at
    such a vertex, are a graph; along one spanning forest of it, those that meet
    at a vertex exchange successors in turn, which puts each circuit into an open
    walk where its component has one and else into one circuit: an open walk
    counts as a circuit from its end back to its start, and the exchange may move
    these, but makes none. Open walks begin where more edges leave and end where
    more arrive, so none comes back to its start. path_id is a walk's smallest
    eid. All of it is joins, sorts and counts; no vertex, circuit or component
    has to fit a task.
    """
    every = table(dense_ids(edges.select(KEY, "eid", "v0", "v1"), "eid", "i"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("v1").alias("v")), F.struct(F.lit(1).alias("way"), F.col("v0").alias("v"))))
    met = table(_numbered(every.select(KEY, "i", ends.alias("w")).select(KEY, "w.way", "w.v", "i"), [KEY, "v", "way"], "i", "k"))
    pairs = met.where("way = 0").select(KEY, "v", "k", "i").join(met.where("way = 1").select(KEY, "v", "k", F.col("i").alias("j")), [KEY, "v", "k"], "full")
    pairs = table(pairs.select(KEY, "v", "i", "j"))
    item = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(KEY), F.col(c).alias("id")))

    def placed(goes: DataFrame) -> DataFrame:
        at = chains(goes.select(F.struct(F.col(KEY), F.col("i").alias("id")).alias("item"), item("j").alias("next")))
        return table(at.select(F.col(f"item.{KEY}").alias(KEY), F.col("item.id").alias("i"), F.col("label.id").alias("c"), "pos", "closed"))

    walks = placed(pairs.where("i IS NOT NULL"))
    rings = walks.where("closed").select(KEY, "i", "c")
    if not rings.isEmpty():
        r = F.min(F.struct("i", "j")).alias("r")
        passed = table(pairs.join(rings, [KEY, "i"]).groupBy(KEY, "v", "c").agg(r))
        beside = pairs.join(passed.select(KEY, "v").distinct(), [KEY, "v"], "left_semi").withColumn("_i", F.coalesce("i", "j"))
        beside = beside.join(walks.where("NOT closed").select(KEY, F.col("i").alias("_i"), "c"), [KEY, "_i"])
        beside = beside.groupBy(KEY, "v").agg(F.min(F.struct("c", "i", "j")).alias("o")).select(KEY, "v", "o.c", F.struct("o.i", "o.j").alias("r"))
        at = passed.unionByName(beside)
        low = at.groupBy(KEY, "v").agg(F.min("c").alias("m"), F.count("*").alias("w")).where("w > 1").drop("w")
        at = table(at.join(low, [KEY, "v"]))
        # A vertex belongs to its smallest circuit or walk; every other one there is an edge to that one.
        tree = spanning_forest(at.where("c <> m").select(item("c").alias("src"), item("m").alias("dst"), F.struct(F.col(KEY), "v", "c").alias("id")))
        tree = table(tree.select(F.col(f"id.{KEY}").alias(KEY), "id.v", "id.c"))
        hubs = tree.join(low, [KEY, "v"]).select(KEY, "v", F.col("m").alias("c")).distinct()
        chosen = table(_numbered(at.join(tree.unionByName(hubs), [KEY, "v", "c"]).select(KEY, "v", "c", "r"), [KEY, "v"], "c", "k"))
        # Each chosen edge goes on where the next one of its vertex did.
        size = chosen.groupBy(KEY, "v").agg(F.count("*").alias("m"))
        after = chosen.select(KEY, "v", F.col("k").alias("to"), F.col("r.j").alias("j2"))
        moved = chosen.join(size, [KEY, "v"]).withColumn("to", (F.col("k") + 1) % F.col("m")).join(after, [KEY, "v", "to"])
        moved = moved.where("r.i IS NOT NULL").select(KEY, F.col("r.i").alias("i"), "j2", F.lit(True).alias("_moved"))
        goes = pairs.where("i IS NOT NULL").join(moved, [KEY, "i"], "left")
        walks = placed(goes.select(KEY, "i", F.when(F.col("_moved"), F.col("j2")).otherwise(F.col("j")).alias("j")))
    label = every.select(KEY, F.col("i").alias("c"), F.col("eid").alias("path_id"))
    return walks.join(every, [KEY, "i"]).join(label, [KEY, "c"]).select(KEY, "eid", "v0", "v1", "path_id", "pos", "closed")


def eulerian_paths(edges: DataFrame) -> DataFrame:
    """The walks of eulerian_steps as paths, a row each: for walks that fit one."""
    return _gather(eulerian_steps(edges).withColumnRenamed("path_id", "label"))


def boundary_paths(faces: DataFrame) -> DataFrame:
    """The boundary as directed loops (first vertex repeated at the end).

    Where every vertex has one way in and one way out at most, loops are placed
    by list ranking; if any is pinched, all are walked as Eulerian paths. A
    loop is named by its smallest vertex, from which it counts.
    """
    e = table(boundary_edges(faces).select(KEY, "v0", "v1"))
    pinched = e.groupBy(KEY, "v0").count().unionByName(e.groupBy(KEY, F.col("v1").alias("v0")).count()).where("count > 1")
    if not pinched.isEmpty():
        walks = eulerian_paths(e.withColumn("eid", F.struct("v0", "v1")))
        return walks.select(KEY, F.col("path_id.v0").alias("path_id"), "vids", "closed")
    on = e.select(KEY, F.col("v0").alias("v1"), F.lit(True).alias("_go"))
    links = e.join(on, [KEY, "v1"], "left").select(F.struct(KEY, F.col("v0").alias("id")).alias("item"), F.when(F.col("_go"), F.struct(F.col(KEY), F.col("v1").alias("id"))).alias("next"))
    placed = chains(links).select(F.col(f"item.{KEY}").alias(KEY), F.col("item.id").alias("v0"), F.col("label.id").alias("label"), "pos", "closed")
    return _gather(placed.join(e, [KEY, "v0"]))


def planar_regions(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Loops of a plane graph: after each directed edge comes the next one clockwise from its reverse.

    mesh_id, region (the smallest dart), vids (first repeated), signed_area.
    """
    d = _darts(edges.where("v0 <> v1"))
    at = points.select(KEY, "vid", "x", "y")
    named = lambda v: at.select(KEY, F.col("vid").alias(v), F.col("x").alias(f"{v}x"), F.col("y").alias(f"{v}y"))
    d = table(d.join(named("u"), [KEY, "u"]).join(named("v"), [KEY, "v"]))
    turn = Window.partitionBy(KEY, "u").orderBy(F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")), "d")
    last = F.last("d").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    around = d.withColumn("before", F.coalesce(F.lag("d").over(turn), last))
    # Arriving by d, go on by the dart just clockwise of d's reverse at the vertex.
    nxt = around.select(KEY, F.col("d").bitwiseXOR(F.lit(1)).alias("d"), F.col("before").alias("next"))
    placed = chains(nxt.select(F.struct(KEY, F.col("d").alias("id")).alias("item"), F.struct(KEY, F.col("next").alias("id")).alias("next")))
    flat = placed.select(F.col(f"item.{KEY}").alias(KEY), F.col("item.id").alias("d"), F.col("label.id").alias("region"), "pos").join(d, [KEY, "d"])
    out = flat.groupBy(KEY, "region").agg(F.sort_array(F.collect_list(F.struct("pos", "u", "v"))).alias("c"), (F.sum(F.col("ux") * F.col("vy") - F.col("vx") * F.col("uy")) / 2).alias("signed_area"))
    return out.select(KEY, "region", F.concat(F.col("c.u"), F.array(F.element_at(F.col("c.v"), -1))).alias("vids"), "signed_area")


def planar_embedding(edges: DataFrame, points: DataFrame) -> DataFrame:
    """mesh_id, region, vids, signed_area, kind, parent: regions of positive area are faces, the others holes but for the most negative, which is left out.

    A hole's parent is the smallest face that holds its first vertex and isn't
    made of it.
    """
    from tessera.operators.spatial import box_pairs

    r = table(planar_regions(edges, points))
    outer = r.groupBy(KEY).agg(F.min(F.struct("signed_area", "region")).alias("o")).select(KEY, F.col("o.region").alias("_outer"))
    r = r.join(outer, KEY).where("NOT (region = _outer AND signed_area <= 0)").drop("_outer")
    r = r.withColumn("kind", F.when(F.col("signed_area") > 0, "face").otherwise("hole"))
    step = r.where("kind = 'face'").select(KEY, "region", "signed_area", F.posexplode("vids").alias("pos", "vid")).join(points.select(KEY, "vid", "x", "y"), [KEY, "vid"])
    poly = step.groupBy(KEY, "region", "signed_area").agg(F.sort_array(F.collect_list(F.struct("pos", "vid", "x", "y"))).alias("c"))
    poly = poly.select(KEY, F.col("region").alias("parent"), F.col("signed_area").alias("_a"), F.transform("c", lambda p: P.vec(p["x"], p["y"])).alias("pts"), F.col("c.vid").alias("_vids"))
    poly = table(poly.withColumns({"_low": P.box_low(F.col("pts")), "_high": P.box_high(F.col("pts"))}))
    first = r.where("kind = 'hole'").select(KEY, "region", F.get("vids", F.lit(0)).alias("vid")).join(points.select(KEY, "vid", "x", "y"), [KEY, "vid"])
    first = table(first)
    p = P.vec(F.col("x"), F.col("y"))
    spots = first.select(KEY, F.col("region").alias("id"), p.alias("low"), p.alias("high"))
    met = box_pairs(spots, poly.select(KEY, F.col("parent").alias("id"), F.col("_low").alias("low"), F.col("_high").alias("high")))
    met = met.select(KEY, F.col("id0").alias("region"), F.col("id1").alias("parent"))
    inside = met.join(first, [KEY, "region"]).join(poly, [KEY, "parent"]).where(~F.array_contains("_vids", F.col("vid")))
    inside = inside.where(P.point_in_polygon2d(p, F.col("pts")) == "inside")
    best = inside.groupBy(KEY, "region").agg(F.min(F.struct("_a", "parent")).alias("b")).select(KEY, "region", F.col("b.parent").alias("parent"))
    return r.join(best, [KEY, "region"], "left")


def path_steps(paths: DataFrame) -> DataFrame:
    """Pairs of successive vertices: mesh_id, path_id, pos, v0, v1."""
    step = F.transform(F.sequence(F.lit(0), F.size("vids") - 2), lambda i: F.struct(F.get("vids", i).alias("v0"), F.get("vids", i + 1).alias("v1")))
    return paths.where(F.size("vids") >= 2).select(KEY, "path_id", F.posexplode(step).alias("pos", "e")).select(KEY, "path_id", "pos", "e.v0", "e.v1")


def ordered_steps(rows: DataFrame, path: str, order: list[str], *columns: str) -> DataFrame:
    """Each row of an ordered path with the next one's columns as next_<column>."""
    w = Window.partitionBy(path).orderBy(*order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
