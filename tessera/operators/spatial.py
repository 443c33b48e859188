"""Spatial joins on grids whose cells are as fine as the data.

A box lies on the level whose cells are about its own size, whatever the others'
sizes are, and so in eight cells at most; it is also entered on the coarser
levels on which boxes of the other side lie. Two boxes meet on the coarser of
their levels, in the first cell they share, so each pair comes up once, large
boxes never spread over many small cells and a dense cluster of small ones is
as far apart as it is anywhere. Points have a tree of cells that go on splitting
where many points lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import primitives as P
from tessera.model import KEY, Mesh, fat_faces
from tessera.operators.triangulate import fat_triangles
from tessera.sources.scratch import merging, table

AXES = P.AXES


def _level(low: int) -> Column:
    """The power of two that is a box's size or next above it, low at least."""
    extent = F.greatest(*[F.col("high")[a] - F.col("low")[a] for a in AXES])
    return F.greatest(F.lit(low), F.ceil(F.log2(F.greatest(extent, F.lit(1e-300))))).cast("int")


def entered(boxes: DataFrame, lowest: int, others: list[int]) -> DataFrame:
    """Box rows (mesh_id, id, low, high, ...) by level and cell, on their own level (_home) and coarser ones among others; _x0, _y0, _z0: their first cell."""
    coarser = F.filter(F.array(*[F.lit(k) for k in others]), lambda k: k > F.col("_own"))
    at = boxes.withColumn("_own", _level(lowest)).withColumn("level", F.explode(F.concat(F.array("_own"), coarser)))
    at = at.withColumn("_size", F.pow(F.lit(2.0), F.col("level")))
    for a in AXES:
        at = at.withColumn(f"_{a}0", F.floor(F.col("low")[a] / F.col("_size"))).withColumn(f"c{a}", F.explode(F.sequence(F.col(f"_{a}0"), F.floor(F.col("high")[a] / F.col("_size")))))
    return at.withColumn("_home", F.col("_own") == F.col("level")).drop("_own", "_size")


def _cells(boxes: DataFrame, lowest: int, others: list[int], side: str) -> DataFrame:
    more = [c for c in boxes.columns if c not in (KEY, "id", "low", "high")]
    at = entered(boxes, lowest, others)
    return at.select(KEY, F.col("id").alias(f"id{side}"), "level", "cx", "cy", "cz", F.col("_home").alias(f"home{side}"), *[F.col(f"_{a}0").alias(f"{a}{side}") for a in AXES], F.col("low").alias(f"low{side}"), F.col("high").alias(f"high{side}"), *[F.col(c).alias(f"{c}{side}") for c in more])


def _roomy(left: DataFrame, right: DataFrame, lowest: int, highest: int, crowd: int) -> tuple[int, float]:
    """The coarsest level, from highest on, where a box has no more than a crowd of others of its mesh in its corner's cell, and how many pairs meet there by these cells.

    On it smaller boxes need no level of their own, so that each is entered on
    few levels. Every round counts all boxes; most data ends at the first.
    """
    every, pairs = left.select(KEY, "low").unionByName(right.select(KEY, "low")), 0.0
    while highest > lowest:
        cells = every.groupBy(KEY, *[F.floor(F.col("low")[a] / 2.0**highest).alias(f"c{a}") for a in AXES]).agg(F.count("*").cast("double").alias("n"))
        ours, pairs = cells.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        pairs = pairs or 0.0
        if not ours or pairs / ours <= crowd:
            return highest, pairs
        highest -= 1
    return lowest, pairs


def box_levels(left: DataFrame, right: DataFrame, crowd: int, above: int = 2) -> tuple[int, list[list[int]], float]:
    """(the lowest level in use, the levels that hold boxes of either side, about how many pairs share a cell).

    Cells up to above levels coarser than the largest box serve for all where
    they hold no more than a crowd.
    """
    extent = F.greatest(*[F.col("high")[a] - F.col("low")[a] for a in AXES])
    far = F.greatest(*[F.greatest(F.abs(F.col("low")[a]), F.abs(F.col("high")[a])) for a in AXES])
    sized = lambda b, n: b.select(F.lit(n).alias("n"), F.when(extent > 0, F.ceil(F.log2(extent)).cast("int")).alias("k"), far.alias("far"))
    sizes = sized(left, 0).unionByName(sized(right, 1)).groupBy("n", "k").agg(F.max("far")).collect()  # a row for each level
    # Cells too small for the coordinates' own precision would not be told apart.
    floor = math.ceil(math.log2(max(max((r[2] for r in sizes if r[2] is not None), default=0.0), 1e-290))) - 44
    known = [max(floor, r[1]) for r in sizes if r[1] is not None] or [floor]
    lowest, pairs = _roomy(left, right, min(known), max(known) + above, crowd)
    return lowest, [sorted({max(lowest, floor if r[1] is None else r[1]) for r in sizes if r[0] == n}) for n in (0, 1)], pairs


def cell_meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Boxes of two sides that share a cell, once for each pair: mesh_id, id0, low0, high0, id1, low1, high1, and what else the sides hold under such names.

    Levels are powers of two, so at most a few dozen hold boxes; a cell that
    very many boxes of one side share is split by adaptive execution.
    """
    lowest, held, _ = box_levels(left, right, _HELD, 0)
    both = _cells(left, lowest, held[1], "0").join(merging(_cells(right, lowest, held[0], "1")), [KEY, "level", "cx", "cy", "cz"])
    first = (F.col("cx") == F.greatest("x0", "x1")) & (F.col("cy") == F.greatest("y0", "y1")) & (F.col("cz") == F.greatest("z0", "z1"))
    return both.where((F.col("home0") | F.col("home1")) & first)


def box_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(mesh_id, id0, id1) of overlapping boxes (mesh_id, id, low, high), each pair once."""
    met = cell_meetings(left, right).where(P.box_overlaps(F.col("low0"), F.col("high0"), F.col("low1"), F.col("high1")))
    return merging(met.select(KEY, "id0", "id1"))


def point_boxes(points: DataFrame, grow: float = 0.0, id_col: str = "vid") -> DataFrame:
    p = P.point()
    return points.select(KEY, F.col(id_col).alias("id"), P.each(lambda c: c - grow, p).alias("low"), P.each(lambda c: c + grow, p).alias("high"))


def face_boxes(mesh: Mesh, grow: float = 0.0) -> DataFrame:
    p = F.col("pts")
    return fat_faces(mesh).select(KEY, F.col("fid").alias("id"), P.each(lambda c: c - grow, P.box_low(p)).alias("low"), P.each(lambda c: c + grow, P.box_high(p)).alias("high"))


def _named(points: DataFrame, id_col: str, n: int) -> DataFrame:
    return points.select(KEY, F.col(id_col).alias(f"id{n}"), P.point().alias(f"p{n}"))


def _near(points: DataFrame, id_col: str, distance: float, half: bool) -> DataFrame:
    """Points in every cell of side distance that they reach, half: in their own and those after it only."""
    rows, left, reach = _named(points, id_col, 0), 0.0, distance * (1 + 1e-9)
    for a in AXES:
        v = F.col("p0")[a]
        if distance <= 0:
            rows = rows.withColumn(f"c{a}", v)
            continue
        rows = rows.withColumn(f"_{a}", F.floor(v / distance)).withColumn(f"c{a}", F.explode(F.sequence(F.floor((v - reach) / distance), F.floor((v + reach) / distance))))
        # How far the cell's nearest side lies, less what rounding may add.
        gap = F.greatest(F.lit(0.0), F.greatest(F.col(f"c{a}") * distance - v, v - (F.col(f"c{a}") + 1) * distance) - F.abs(v) * 1e-15)
        left = left + gap * gap
        rows = rows.where(left <= reach * reach)
    if half and distance > 0:
        rows = rows.where(F.struct("cx", "cy", "cz") >= F.struct("_x", "_y", "_z")).withColumn("_home", (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")) & (F.col("cz") == F.col("_z")))
    return rows.select(KEY, "id0", "p0", "cx", "cy", "cz", *(["_home"] if half and distance > 0 else []))


def _meet_within(left: DataFrame, right: DataFrame, distance: float, left_id: str, right_id: str, half: bool = False) -> DataFrame:
    cell = lambda v: F.floor(v / distance) if distance > 0 else v
    held = _named(right, right_id, 1).withColumns({f"c{a}": cell(F.col("p1")[a]) for a in AXES})
    both = _near(left, left_id, distance, half).join(merging(held), [KEY, "cx", "cy", "cz"])
    return both.withColumn("d2", P.distance2(F.col("p0"), F.col("p1"))).where(F.col("d2") <= distance * distance)


def pairs_within(left: DataFrame, right: DataFrame, distance: float, left_id: str = "vid", right_id: str = "vid") -> DataFrame:
    """(mesh_id, id0, id1, d2) of points of two sets within a distance.

    Points of the left side come, with their coordinates, to all cells of that
    size within reach, so each pair comes up once, in one join, and no table of
    pairs is shuffled.
    """
    return merging(_meet_within(left, right, distance, left_id, right_id).select(KEY, "id0", "id1", "d2"))


def self_pairs_within(points: DataFrame, distance: float, id_col: str = "vid") -> DataFrame:
    """pairs_within of one set with id0 < id1: each point meets its own cell and those after it."""
    met = _meet_within(points, points, distance, id_col, id_col, half=True)
    met = met.where("NOT _home OR id0 < id1" if distance > 0 else "id0 < id1")
    return merging(met.select(KEY, F.least("id0", "id1").alias("id0"), F.greatest("id0", "id1").alias("id1"), "d2"))


#: Side of a cell, in distances, whose points are all within the distance of each other whatever rounding does.
_CLOSE = 0.577
#: Points of a set's own cells that a point meets, on average, above which near_links doesn't list pairs.
_DENSE = 4


def near_links(points: DataFrame, distance: float, id_col: str = "vid") -> DataFrame:
    """(mesh_id, id0, id1) that connect the points as all pairs within the distance do.

    Where points are dense, all pairs would be far more than the points. Cells
    whose points are all near each other link to their smallest id; cells about
    are linked where some of their outermost points are near, and the points of
    the rest meet only where the links so far leave two cells apart.
    """
    rows = _named(points, id_col, 0).where(" AND ".join(f"p0.{a} IS NOT NULL" for a in AXES))
    side, reach = distance * _CLOSE, distance * (1 + 1e-9)
    cell = [F.floor(F.col("p0")[a] / side).alias(f"c{a}") for a in AXES]
    counts = rows.groupBy(KEY, *cell).agg(F.count("*").cast("double").alias("n"), F.max(F.greatest(*[F.abs(F.col("p0")[a]) for a in AXES])).alias("far"))
    n, pairs, far = counts.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("far")).first()
    if not n or pairs <= _DENSE * n or not far / side < 2.0**50:  # cells that far out aren't told apart, and NaN has none
        return self_pairs_within(points, distance, id_col).select(KEY, "id0", "id1")
    from tessera.operators.graph import connected_components

    at = table(rows.select(KEY, "id0", "p0", *cell))
    turned = [F.struct(*[F.col("p0")[AXES[(k + i) % 3]].alias(AXES[(k + i) % 3]) for i in range(3)]) for k in range(3)]
    ends = [f(t).alias(f"_{i}{k}") for k, t in enumerate(turned) for i, f in enumerate((F.min, F.max))]
    cells = at.groupBy(KEY, "cx", "cy", "cz").agg(F.min("id0").alias("c"), *ends)
    spot = lambda c: F.struct(*[F.col(c)[a].alias(a) for a in AXES])
    box = lambda i: F.struct(*[F.col(f"_{i}{k}")[a].alias(a) for k, a in enumerate(AXES)])
    cells = table(cells.select(KEY, "cx", "cy", "cz", "c", F.array(*[spot(f"_{i}{k}") for i in (0, 1) for k in range(3)]).alias("w"), box(0).alias("l"), box(1).alias("h")))
    named = lambda i, *more: [F.col(c).alias(f"{c}{i}") for c in ("c", "w", "l", "h", *more)]
    about = cells.select(KEY, *named(0), F.struct("cx", "cy", "cz").alias("_own"))
    for a in AXES:
        about = about.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.col("l0")[a] - reach) / side), F.floor((F.col("h0")[a] + reach) / side))))
    both = about.where(F.struct("cx", "cy", "cz") > F.col("_own")).drop("_own").join(cells.select(KEY, "cx", "cy", "cz", *named(1)), [KEY, "cx", "cy", "cz"])
    gap = lambda low, high, l, h: sum((F.pow(F.greatest(F.lit(0.0), l[a] - high[a], low[a] - h[a]), F.lit(2.0)) for a in AXES), F.lit(0.0))
    both = both.where(gap(F.col("l0"), F.col("h0"), F.col("l1"), F.col("h1")) <= reach * reach)
    near = F.exists("w0", lambda p: F.exists("w1", lambda q: P.distance2(p, q) <= distance * distance))
    both = table(both.select(KEY, "c0", "c1", near.alias("near"), *[F.when(~near, F.col(c)).alias(c) for c in ("l0", "h0", "l1", "h1")]))
    links = both.where("near").select(KEY, F.col("c0").alias("id0"), F.col("c1").alias("id1"))
    found = connected_components(links, "id0", "id1", [KEY])
    left = both.where("NOT near")
    for i in (0, 1):
        left = left.join(found.select(KEY, F.col("node").alias(f"c{i}"), F.col("label").alias(f"r{i}")), [KEY, f"c{i}"], "left").withColumn(f"r{i}", F.coalesce(f"r{i}", f"c{i}"))
    left = table(left.where("r0 <> r1"))
    # The points of either cell that may reach the other's box.
    own = table(at.join(cells.select(KEY, "cx", "cy", "cz", "c"), [KEY, "cx", "cy", "cz"]).select(KEY, "id0", "p0", "c"))
    for i in (0, 1):
        p, o = F.col(f"p{i}"), 1 - i
        left = left.join(own.select(KEY, F.col("c").alias(f"c{i}"), F.col("p0").alias(f"p{i}")), [KEY, f"c{i}"]).where(gap(p, p, F.col(f"l{o}"), F.col(f"h{o}")) <= reach * reach)
    met = left.where(P.distance2(F.col("p0"), F.col("p1")) <= distance * distance).select(KEY, F.col("r0").alias("id0"), F.col("r1").alias("id1")).distinct()
    inside = own.where("id0 <> c").select(KEY, "id0", F.col("c").alias("id1"))
    return merging(inside.unionByName(found.select(KEY, F.col("node").alias("id0"), F.col("label").alias("id1"))).unionByName(met))


def search(boxes: DataFrame, low: Column, high: Column, also: Column | None = None) -> DataFrame:
    """Boxes (mesh_id, id, low, high, ...) that meet one box and a predicate, for any aggregate after."""
    out = boxes.where(P.box_overlaps(F.col("low"), F.col("high"), low, high))
    return out if also is None else out.where(also)


def ids_meeting(rows: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which an exact test against one primitive holds."""
    return rows.where(predicate)


#: Boxes of both sides in a cell, on average, that are met without cells of their own size.
_HELD = 256
#: Triangles or points of a mesh that a query meets without a search.
_FEW = 64
#: Points in a cell above which it splits, times k; levels that a split goes down.
_CROWD, _DOWN = 16, 3


def _tree(held: DataFrame, dims: list[str], size: float, top: int, crowd: int) -> tuple[DataFrame, int]:
    """(counts of points by mesh_id, level and cell, the lowest level), from cells on level 0 that split while they are crowded.

    A round counts only points of crowded cells, on cells an eighth as long.
    Cells of a split level are known wherever the one above was crowded; counts
    on coarser levels are sums of finer ones.
    """
    cell = lambda a, level: F.floor(F.col("p")[a] / (2.0**level * size)).alias(f"c{a}")
    names = [f"c{a}" for a in dims]
    level, points, leaves = 0, held.select(KEY, "p"), None
    while True:
        at = points.select(KEY, "p", *[cell(a, level) for a in dims])
        counts = table(at.groupBy(KEY, *names).agg(F.count("*").alias("n"), F.min("p").alias("_l"), F.max("p").alias("_h")))
        crowded = counts.where((F.col("n") > crowd) & (F.col("_l") != F.col("_h")))  # equal points can't be told apart
        done = level - _DOWN < -60 or crowded.isEmpty()
        calm = counts if done else counts.join(crowded.select(KEY, *names), [KEY, *names], "left_anti")
        calm = calm.select(KEY, F.lit(level).alias("level"), *names, "n")
        leaves = calm if leaves is None else leaves.unionByName(calm)
        if done:
            break
        points = table(at.join(crowded.select(KEY, *names), [KEY, *names], "left_semi").select(KEY, "p"))
        level -= _DOWN
    up = leaves.select(KEY, F.explode(F.sequence("level", F.lit(top))).alias("_to"), "level", *names, "n")
    up = up.select(KEY, F.col("_to").alias("level"), *[F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_to") - F.col("level"))).alias(c) for c in names], "n")
    return table(up.groupBy(KEY, "level", *names).agg(F.sum("n").alias("n"))), level


def _around(rows: DataFrame, dims: list[str], size: float) -> DataFrame:
    """Each query with the cells of its level next to it."""
    for a in dims:
        c = F.floor(F.col("q")[a] / (F.pow(F.lit(2.0), F.col("level")) * size))
        rows = rows.withColumn(f"c{a}", F.explode(F.sequence(c - 1, c + 1)))
    return rows


def _levels(queries: DataFrame, counts: DataFrame, dims: list[str], size: float, lowest: int, top: int) -> DataFrame:
    """queries (mesh_id, qid, q, want) with the lowest level on which the cells around each hold want points.

    The number never falls from one level to the next coarser one, so level 0 is
    asked first and each round then halves the levels left.
    """
    names = [f"c{a}" for a in dims]
    left = table(queries.withColumns({"_low": F.lit(lowest), "_high": F.lit(top), "level": F.lit(min(max(0, lowest), top))}))
    found = None
    while True:
        seen = _around(left, dims, size).join(counts, [KEY, "level", *names]).groupBy(KEY, "qid").agg(F.sum("n").alias("m"))
        enough = F.coalesce(F.col("m"), F.lit(0)) >= F.col("want")
        asked = left.join(seen, [KEY, "qid"], "left")
        asked = asked.withColumns({"_high": F.when(enough, F.col("level")).otherwise(F.col("_high")), "_low": F.when(enough, F.col("_low")).otherwise(F.least(F.col("level") + 1, F.col("_high")))})
        # Few points around already: finer cells would save nothing.
        ready = (F.col("_low") >= F.col("_high")) | (enough & (F.col("m") <= 4 * _CROWD * F.col("want")))
        asked = table(asked.withColumn("_ready", ready).drop("m"))
        here = asked.where("_ready").select(*queries.columns, F.col("_high").alias("level"))
        found = here if found is None else found.unionByName(here)
        left = asked.where("NOT _ready").drop("_ready").withColumn("level", F.floor((F.col("_low") + F.col("_high")) / 2).cast("int"))
        if left.isEmpty():
            return table(found)


def _narrowed(cells: DataFrame, counts: DataFrame, dims: list[str], size: float) -> DataFrame:
    """Queries with cells, split where these hold many points, without those too far for the wanted points.

    The nearest cells that hold want points say how far the last of these can
    lie; cells that begin beyond it go. A far query meets a thin shell of small
    cells, instead of large ones whole. Cells that the tree doesn't split stay.
    """
    names = [f"c{a}" for a in dims]
    known = [KEY, "level", *names]
    rows = cells.join(merging(counts), known, "left").withColumns({"_leaf": F.col("n").isNull(), "n": F.coalesce("n", F.lit(0).cast("long"))})
    below = counts.select(KEY, (F.col("level") + 1).alias("level"), *[F.floor(F.col(c) / 2).alias(c) for c in names], *[F.col(c).alias(f"_{c}") for c in names], F.col("n").alias("_n"))
    query = Window.partitionBy(KEY, "qid")
    while True:
        near, far, side = F.lit(0.0), F.lit(0.0), F.pow(F.lit(2.0), F.col("level")) * size
        for a in dims:
            q, low, high = F.col("q")[a], F.col(f"c{a}") * side, (F.col(f"c{a}") + 1) * side
            slack = (F.abs(q) + F.abs(low) + F.abs(high)) * 1e-15  # what rounding may add
            gap, span = F.greatest(F.lit(0.0), F.greatest(low - q, q - high) - slack), F.greatest(F.abs(q - low), F.abs(q - high)) + slack
            near, far = near + gap * gap, far + span * span
        rows = rows.withColumns({"_near": near, "_far": far})
        rows = rows.withColumn("_sum", F.sum("n").over(query.orderBy("_far")))
        rows = rows.withColumn("_most", F.least(F.min(F.when(F.col("_sum") >= F.col("want"), F.col("_far"))).over(query), "reach"))
        rows = rows.where("_most IS NULL OR _near * (1 - 1e-9) <= _most").withColumn("_busy", ~F.col("_leaf") & (F.sum("n").over(query) > 4 * _CROWD * F.col("want")))
        rows = table(rows.select(*cells.columns, "n", "_leaf", "_busy"))
        if rows.where("_busy").isEmpty():
            return rows.select(*cells.columns)
        split = rows.where("_busy").join(below, known, "left")
        split = split.withColumns({"_leaf": F.col("_n").isNull(), "n": F.coalesce("_n", "n"), "level": F.when(F.col("_n").isNull(), F.col("level")).otherwise(F.col("level") - 1), **{c: F.coalesce(f"_{c}", c) for c in names}})
        rows = rows.where("NOT _busy").drop("_busy").unionByName(split.select(*cells.columns, "n", "_leaf"))


def _meetings(asked: DataFrame, held: DataFrame, counts: DataFrame, dims: list[str], size: float) -> DataFrame:
    """Queries (with level and reach, the largest d2 that counts) and the points in the cells around them that may be wanted."""
    names = [f"c{a}" for a in dims]
    around = _narrowed(_around(asked, dims, size), counts, dims, size)
    used = sorted(r[0] for r in around.select("level").distinct().collect())  # no more than the tree has levels
    at = held.withColumn("level", F.explode(F.array(*[F.lit(x) for x in used]))) if used else held.withColumn("level", F.lit(0))
    at = at.withColumns({f"c{a}": F.floor(F.col("p")[a] / (F.pow(F.lit(2.0), F.col("level")) * size)) for a in dims})
    return around.join(at, [KEY, "level", *names]).withColumn("d2", P.distance2(F.col("p"), F.col("q"))).where("reach IS NULL OR d2 <= reach")


def knn(points: DataFrame, queries: DataFrame, k: int = 1, radius: float | None = None, size: float | None = None) -> DataFrame:
    """The k nearest points (mesh_id, vid, x, y, z) of each query (mesh_id, qid, x, y, z), of one mesh_id: mesh_id, qid, vid, d2, rank.

    Counts of points by cell, on levels of cells twice as large each, say at
    which level the cells around a query hold k points, or all of a mesh that
    has fewer; where points are dense, cells split further, so neither clusters
    nor outliers change how many a query meets. The points of these 27 cells
    give the k-th distance; where it reaches beyond them, the level that covers
    it is searched once more. So a query meets points twice at most, however far
    they lie. Queries of a mesh of few points pass through these instead. Ties go
    to the smaller vid. radius is a plain distance; fewer than
    k may lie within it. size: the cells of level 0.
    """
    small = table(points.groupBy(KEY).agg((F.count("*") <= _FEW).alias("_few")))
    few = small.where("_few").select(KEY)
    if few.isEmpty():
        return _knn(points, queries, k, radius, size)
    lists = points.join(few, KEY).groupBy(KEY).agg(F.collect_list(F.struct("vid", P.point().alias("p"))).alias("_held"))
    best = table(_knn_of_few(lists, queries, k, radius))
    large = small.where("NOT _few").select(KEY)
    if large.isEmpty():
        return best
    points, queries = (merging(t.join(large, KEY, "left_semi")) for t in (points, queries))
    return merging(best.unionByName(_knn(points, queries, k, radius, size)))


def _knn_of_few(lists: DataFrame, queries: DataFrame, k: int, radius: float | None) -> DataFrame:
    """knn of meshes of few points, held as a list (mesh_id, _held): each query passes through its mesh's list."""
    at = queries.select(KEY, "qid", P.point().alias("q")).join(merging(lists), KEY)
    d = F.transform("_held", lambda h: F.struct(P.distance2(h["p"], F.col("q")).alias("d2"), h["vid"].alias("vid")))
    d = F.filter(d, lambda h: h["d2"].isNotNull() if radius is None else h["d2"] <= float(radius) ** 2)
    at = at.select(KEY, "qid", d.alias("d")).where(F.size("d") > 0)
    best = F.array(F.array_min("d")) if k == 1 else F.slice(F.sort_array("d"), 1, k)
    return at.select(KEY, "qid", F.posexplode(best).alias("pos", "b")).select(KEY, "qid", "b.vid", "b.d2", (F.col("pos") + 1).alias("rank"))


def _knn(points: DataFrame, queries: DataFrame, k: int, radius: float | None, size: float | None) -> DataFrame:
    ends = points.select(*AXES).unionByName(queries.select(*AXES)).agg(*[f(a) for a in AXES for f in (F.min, F.max)]).first()
    if ends[0] is None:
        return points.join(queries.limit(0), KEY).select(KEY, "qid", "vid", F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    spans = [ends[2 * i + 1] - ends[2 * i] for i in range(3)]
    held = table(points.select(KEY, "vid", P.point().alias("p")))
    if size is None:
        live = [s for s in spans if s > 0] or [1.0]
        size = max((math.prod(live) * max(k, 4) / max(1, held.count())) ** (1 / len(live)), max(live) * 1e-4)
    top = max(0, math.ceil(math.log2(max(max(spans) / size, 1.0))))
    if radius is not None:
        top = min(top, max(0, math.ceil(math.log2(max(radius / size, 1e-300)))))
    dims = [a for a, s in zip(AXES, spans, strict=True) if s > 0] or ["x"]
    left = queries.select(KEY, "qid", P.point().alias("q")).join(held.groupBy(KEY).agg(F.least(F.count("*"), F.lit(k)).alias("want")), KEY)
    counts, lowest = _tree(held, dims, size, top, _CROWD * max(k, 4))
    ready = _levels(left, counts, dims, size, lowest, top)
    w = Window.partitionBy(KEY, "qid").orderBy("d2", "vid")
    ranked = lambda met: table(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(KEY, "qid", "vid", "d2", "rank"))
    limit = F.lit(None).cast("double") if radius is None else F.lit(float(radius) ** 2)
    best = ranked(_meetings(ready.withColumn("reach", limit), held, counts, dims, size))
    far = best.groupBy(KEY, "qid").agg(F.max("d2").alias("_d"), F.count("*").alias("_n"))
    # With fewer than wanted, only a radius can end the search: then the last level has covered it.
    reach = F.when(F.col("_n") >= F.col("want"), F.col("_d")).otherwise(limit)
    again = ready.join(far, [KEY, "qid"], "left").withColumn("reach", reach).where(F.col("reach") > F.pow(F.pow(F.lit(2.0), F.col("level")) * size, F.lit(2.0)))
    again = table(again.withColumn("level", F.greatest(F.lit(lowest), F.ceil(F.log2(F.sqrt("reach") / size))).cast("int")).select(*ready.columns, "reach"))
    if again.isEmpty():
        return best
    return best.join(again.select(KEY, "qid"), [KEY, "qid"], "left_anti").unionByName(ranked(_meetings(again, held, counts, dims, size)))


def _triangles(mesh: Mesh) -> DataFrame:
    """mesh_id, id, vids, pts: the triangles of all faces; id names face and triangle."""
    return fat_triangles(mesh).select(KEY, F.struct("fid", "tri").alias("id"), "vids", "pts")


def nearest_faces(mesh: Mesh, queries: DataFrame, radius: float | None = None) -> DataFrame:
    """The nearest face of each query, within radius where there is one: mesh_id, qid, fid, d2, point.

    Queries of a mesh of few triangles meet them all. In other meshes no face is
    farther than its nearest vertex, so each query looks as far as the nearest
    vertex of a face lies. Faces of any number of corners are met as triangles;
    ties go to the smaller fid.
    """
    f = table(_triangles(mesh))
    small = table(f.groupBy(KEY).agg((F.count("*") <= _FEW).alias("_few")))
    at = queries.select(KEY, F.col("qid").alias("id0"), P.point().alias("p0"))
    best = _nearest(at.join(small.where("_few").select(KEY), KEY).join(f.select(KEY, F.col("id").alias("id1"), "pts"), KEY), radius)
    large = small.where("NOT _few").select(KEY)
    if large.isEmpty():
        return best
    f, queries = (merging(t.join(large, KEY, "left_semi")) for t in (f, queries))
    named = mesh.points.join(f.select(KEY, F.explode("vids").alias("vid")).distinct(), [KEY, "vid"], "left_semi")
    far = knn(named, queries, 1).select(KEY, "qid", F.sqrt("d2").alias("far"))
    at = queries.join(far, [KEY, "qid"]).withColumn("far", F.col("far") * (1 + 1e-9) + 1e-12)
    at = table(at if radius is None else at.withColumn("far", F.least("far", F.lit(float(radius)))))
    p = F.col("pts")
    spots = at.select(KEY, F.col("qid").alias("id"), P.each(lambda v: v - F.col("far"), P.point()).alias("low"), P.each(lambda v: v + F.col("far"), P.point()).alias("high"))
    met = box_pairs(spots, f.select(KEY, "id", P.box_low(p).alias("low"), P.box_high(p).alias("high")))
    both = met.join(_named(at, "qid", 0), [KEY, "id0"]).join(f.select(KEY, F.col("id").alias("id1"), "pts"), [KEY, "id1"])
    return best.unionByName(_nearest(both, radius))


def _nearest(both: DataFrame, radius: float | None) -> DataFrame:
    """nearest_faces of queries (mesh_id, id0, p0) with the triangles (id1, pts) that each meets."""
    c = [F.get("pts", F.lit(i)) for i in range(3)]
    both = P.with_closest_on_triangle(both, F.col("p0"), *c).withColumn("d2", P.distance2(F.col("p0"), F.col("point")))
    both = both if radius is None else both.where(F.col("d2") <= radius * radius)
    best = both.groupBy(KEY, F.col("id0").alias("qid")).agg(F.min(F.struct("d2", F.col("id1.fid").alias("fid"), "point")).alias("b"))
    return best.select(KEY, "qid", "b.fid", "b.d2", "b.point")


def closest_pair(points: DataFrame, queries: DataFrame, radius: float | None = None) -> DataFrame:
    """The closest pair of two sets, one row for each mesh_id: mesh_id, qid, vid, d2."""
    best = knn(points, queries, 1, radius).groupBy(KEY).agg(F.min(F.struct("d2", "qid", "vid")).alias("b"))
    return best.select(KEY, "b.qid", "b.vid", "b.d2")


def set_distance(points: DataFrame, queries: DataFrame) -> DataFrame:
    return closest_pair(points, queries).select(KEY, F.sqrt("d2").alias("distance"))


def ray_hits(mesh: Mesh, rays: DataFrame, pieces: int = 64) -> DataFrame:
    """The nearest hit of each ray (mesh_id, ray_id, ox, oy, oz, dx, dy, dz, min_t, max_t) on faces: mesh_id, ray_id, fid, t, point.

    A ray is cut where it leaves the mesh's box and into pieces, whose boxes
    meet those of faces; hits are then exact. Rays without a hit have no row.
    """
    tri = table(_triangles(mesh))
    ends = tri.select(KEY, P.box_low(F.col("pts")).alias("l"), P.box_high(F.col("pts")).alias("h")).groupBy(KEY)
    ends = ends.agg(*[f(F.col(c)[a]).alias(f"{c}{a}") for c, f in (("l", F.min), ("h", F.max)) for a in AXES])
    o, d = P.vec(F.col("ox"), F.col("oy"), F.col("oz")), P.vec(F.col("dx"), F.col("dy"), F.col("dz"))
    r = rays.join(ends, KEY)
    low, high = P.vec(F.col("lx"), F.col("ly"), F.col("lz")), P.vec(F.col("hx"), F.col("hy"), F.col("hz"))
    enter, leave = [F.col("min_t")], [F.col("max_t")]
    for a in AXES:
        inv = 1 / F.when(F.abs(d[a]) > 1e-300, d[a])
        enter.append(F.least((low[a] - o[a]) * inv, (high[a] - o[a]) * inv))
        leave.append(F.greatest((low[a] - o[a]) * inv, (high[a] - o[a]) * inv))
    r = r.withColumns({"_t0": F.greatest(*enter), "_t1": F.least(*leave)}).where("_t0 <= _t1")
    cut = r.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    at = lambda k: P.add(o, P.scale(d, F.col("_t0") + (F.col("_t1") - F.col("_t0")) * (F.col("_i") + k) / pieces))
    slack = 1e-9
    boxes = cut.select(KEY, F.col("ray_id").alias("id"), P.each(lambda a, b: F.least(a, b) - slack, at(0), at(1)).alias("low"), P.each(lambda a, b: F.greatest(a, b) + slack, at(0), at(1)).alias("high"))
    p = F.col("pts")
    faces = tri.select(KEY, "id", P.box_low(p).alias("low"), P.box_high(p).alias("high"))
    met = box_pairs(boxes, faces).distinct().select(KEY, F.col("id0").alias("ray_id"), F.col("id1").alias("id"))
    both = met.join(rays, [KEY, "ray_id"]).join(tri.select(KEY, "id", "pts"), [KEY, "id"])
    hit = both.withColumn("h", P.ray_triangle(o, d, *[F.get("pts", F.lit(i)) for i in range(3)], F.col("min_t"), F.col("max_t"))).where("h.status = 'intersection'")
    best = hit.groupBy(KEY, "ray_id").agg(F.min(F.struct("h.t", "id.fid", "h.point")).alias("b"))
    return best.select(KEY, "ray_id", "b.fid", "b.t", "b.point")


#: Directions of the crossing test: off every axis and diagonal, so that edge hits are rare; the next is used where one occurs.
_TILTS = ((0.0137421, 0.0291733), (-0.0410287, 0.0173529), (0.0219041, -0.0371113), (-0.0317733, -0.0203391), (0.0470119, 0.0118827), (-0.0081553, 0.0433721))


def _tilted(a: float, b: float) -> Callable[[Column], Column]:
    """The shadow of a point along (1, a, b) on the plane x = 0."""
    return lambda p: P.vec(0.0, p["y"] - a * p["x"], p["z"] - b * p["x"])


def points_in_mesh(mesh: Mesh, queries: DataFrame) -> DataFrame:
    """mesh_id, qid, side (inside or outside) of points against a closed mesh of any faces.

    Signed crossings of a ray are summed; along a fixed tilted direction the
    search is a join of points with the shadows of the faces' triangles.
    """
    return points_in_triangles(table(_triangles(mesh)), queries)


def points_in_triangles(tri: DataFrame, queries: DataFrame) -> DataFrame:
    """points_in_mesh for a closed mesh's triangles (mesh_id, id, pts), written."""
    left, out = queries.select(KEY, "qid", "x", "y", "z"), None
    for n, (a, b) in enumerate(_TILTS):
        flat = _tilted(a, b)
        shadow = tri.select(KEY, "id", F.transform("pts", flat).alias("s"))
        boxes = shadow.select(KEY, "id", P.box_low(F.col("s")).alias("low"), P.box_high(F.col("s")).alias("high"))
        spot = left.select(KEY, F.col("qid").alias("id"), flat(P.point()).alias("low")).withColumn("high", F.col("low"))
        met = box_pairs(spot, boxes).select(KEY, F.col("id0").alias("qid"), F.col("id1").alias("id"))
        both = met.join(left.select(KEY, "qid", P.point().alias("q")), [KEY, "qid"]).join(tri.select(KEY, "id", "pts"), [KEY, "id"])
        q = flat(F.col("q"))
        c = [flat(F.get("pts", F.lit(i))) for i in range(3)]
        turn = lambda u, v: (u["y"] - q["y"]) * (v["z"] - q["z"]) - (v["y"] - q["y"]) * (u["z"] - q["z"])
        both = both.withColumns({"w0": turn(c[1], c[2]), "w1": turn(c[2], c[0]), "w2": turn(c[0], c[1])})
        total = F.col("w0") + F.col("w1") + F.col("w2")
        x = sum((F.col(f"w{i}") * F.get("pts", F.lit(i))["x"] for i in range(3)), F.lit(0.0)) / total
        same = ((F.col("w0") > 0) & (F.col("w1") > 0) & (F.col("w2") > 0)) | ((F.col("w0") < 0) & (F.col("w1") < 0) & (F.col("w2") < 0))
        tiny = 1e-12 * F.abs(total)
        close = (F.abs("w0") <= tiny) | (F.abs("w1") <= tiny) | (F.abs("w2") <= tiny)
        ahead = x > F.col("q")["x"]
        sums = both.groupBy(KEY, "qid").agg(F.sum(F.when(same & ahead, F.signum(total)).otherwise(0.0)).alias("n"), F.bool_or(close & (total != 0)).alias("edge"))
        found = left.join(sums, [KEY, "qid"], "left").select(KEY, "qid", F.when(F.coalesce("n", F.lit(0.0)) != 0, "inside").otherwise("outside").alias("side"), F.coalesce("edge", F.lit(False)).alias("edge"))
        found = table(found)
        last = n == len(_TILTS) - 1
        good = found if last else found.where("NOT edge")
        out = good if out is None else out.unionByName(good)
        again = found.where("edge")
        if last or again.isEmpty():
            break
        left = merging(left.join(again.select(KEY, "qid"), [KEY, "qid"], "left_semi"))
    return out.select(KEY, "qid", "side")


def index_cells(boxes: DataFrame, size: float) -> DataFrame:
    """A stored index: boxes (mesh_id, id, low, high) with the cells they touch at one size."""
    at = boxes
    for a in AXES:
        at = at.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col("low")[a] / size), F.floor(F.col("high")[a] / size))))
    return at


def update_index(index: DataFrame, index_map: DataFrame, dirty: DataFrame, size: float) -> DataFrame:
    """The index after a change: clean rows keep their cells under new ids, removed and dirty rows leave, dirty boxes (under new ids) enter."""
    moved = index.join(index_map.where("new_id IS NOT NULL").withColumnRenamed("old_id", "id"), [KEY, "id"]).withColumn("id", F.col("new_id")).select(*index.columns)
    clean = moved.join(dirty.select(KEY, "id").distinct(), [KEY, "id"], "left_anti")
    return clean.unionByName(index_cells(dirty, size).select(*index.columns))


def form_meets(pairs: DataFrame, exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """mesh_id of meshes with a pair that an exact test keeps."""
    return exact(pairs).select(KEY).distinct()
