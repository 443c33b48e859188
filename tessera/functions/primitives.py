"""Geometry of single primitives as Column expressions, all inside code generation.

A vector or point is a struct<x, y, z>. A segment is two points; rays and lines
are an origin and a direction; planes a unit normal n and an offset d with
n . p + d = 0; boxes two corner points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import EPS, EPS2

AXES = ("x", "y", "z")


def vec(x, y, z=0.0) -> Column:
    c = [v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y, z)]
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(c, AXES, strict=True)])


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, for expressions that need it in many places."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point() -> Column:
    """The coordinates of a row of points."""
    return F.struct("x", "y", "z")


def each(f, *vectors: Column) -> Column:
    return F.struct(*[f(*(v[a] for v in vectors)).alias(a) for a in AXES])


def add(a: Column, b: Column) -> Column:
    return each(lambda p, q: p + q, a, b)


def sub(a: Column, b: Column) -> Column:
    return each(lambda p, q: p - q, a, b)


def scale(a: Column, s) -> Column:
    return each(lambda p: p * s, a)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length2(a: Column) -> Column:
    return dot(a, a)


def length(a: Column) -> Column:
    return F.sqrt(length2(a))


def normalized(a: Column) -> Column:
    """Null for a vector of no length."""
    n = length(a)
    return F.when(n > 0, scale(a, 1 / n))


def angle(a: Column, b: Column) -> Column:
    """Between two vectors, in radians."""
    return F.atan2(length(cross(a, b)), dot(a, b))


def dot_nd(a: Column, b: Column) -> Column:
    """Of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)


def distance2_nd(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p)


# Transformations: row-major 4x4 matrices, as lists of numbers or an array column.


def _entry(m, k: int):
    return m[k] if isinstance(m, Column) else float(m[k])


def transform_point(p: Column, m) -> Column:
    return vec(*[sum((p[a] * _entry(m, 4 * r + c) for c, a in enumerate(AXES)), F.lit(0.0)) + _entry(m, 4 * r + 3) for r in range(3)])


def transform_vector(v: Column, m) -> Column:
    return vec(*[sum((v[a] * _entry(m, 4 * r + c) for c, a in enumerate(AXES)), F.lit(0.0)) for r in range(3)])


def transform_normal(n: Column, m) -> Column:
    """By the inverse transpose, made a unit vector again."""
    e = lambda r, c: _entry(m, 4 * (r % 3) + c % 3)
    cofactor = lambda r, c: e(r + 1, c + 1) * e(r + 2, c + 2) - e(r + 1, c + 2) * e(r + 2, c + 1)
    return normalized(vec(*[sum((n[a] * cofactor(r, c) for c, a in enumerate(AXES)), F.lit(0.0)) for r in range(3)]))


def translation(x: float, y: float, z: float = 0.0) -> list[float]:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m.ravel().tolist()


def rotation(axis: Sequence[float], radians: float, pivot: Sequence[float] = (0, 0, 0)) -> list[float]:
    """About an axis through pivot (Rodrigues)."""
    x, y, z = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    m = np.eye(4)
    m[:3, :3] += np.sin(radians) * k + (1 - np.cos(radians)) * k @ k
    m[:3, 3] = np.asarray(pivot, float) - m[:3, :3] @ pivot
    return m.ravel().tolist()


def rotation_between(a: Sequence[float], b: Sequence[float]) -> list[float]:
    """Turns direction a to direction b the short way."""
    u, v = np.asarray(a, float) / np.linalg.norm(a), np.asarray(b, float) / np.linalg.norm(b)
    axis = np.cross(u, v)
    if np.linalg.norm(axis) < EPS:
        if u @ v > 0:
            return np.eye(4).ravel().tolist()
        axis = np.cross(u, np.eye(3)[np.argmin(np.abs(u))])
    return rotation(axis, float(np.arctan2(np.linalg.norm(np.cross(u, v)), u @ v)))


def compose(*matrices: Sequence[float]) -> list[float]:
    """One matrix that does the last first."""
    return reduce(np.matmul, (np.reshape(m, (4, 4)) for m in matrices)).ravel().tolist()


# Closest points and distances.


def _clamp(t: Column, low=0.0, high=1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), t))


def _along(p: Column, origin: Column, direction: Column) -> Column:
    n = length2(direction)
    return F.when(n > 0, dot(sub(p, origin), direction) / n).otherwise(0.0)


def closest_on_segment(p: Column, a: Column, b: Column) -> Column:
    d = sub(b, a)
    return add(a, scale(d, _clamp(_along(p, a, d))))


def closest_on_ray(p: Column, origin: Column, direction: Column) -> Column:
    return add(origin, scale(direction, F.greatest(F.lit(0.0), _along(p, origin, direction))))


def closest_on_line(p: Column, origin: Column, direction: Column) -> Column:
    return add(origin, scale(direction, _along(p, origin, direction)))


def closest_on_plane(p: Column, n: Column, d) -> Column:
    return sub(p, scale(n, plane_distance(p, n, d)))


def closest_in_box(p: Column, low: Column, high: Column) -> Column:
    return each(lambda c, a, b: F.greatest(a, F.least(b, c)), p, low, high)


def closest_on_triangle(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Through the regions of the corners, the sides and the face."""
    names = ("p", "a", "b", "c")

    def products(r: Column) -> Column:
        p, a, b, c = (r[n] for n in names)
        ab, ac = sub(b, a), sub(c, a)
        d = [dot(side, sub(p, corner)) for corner in (a, b, c) for side in (ab, ac)]
        return let(F.struct(*[x.alias(f"d{i + 1}") for i, x in enumerate(d)]), lambda d: place(r, d))

    def place(r: Column, d: Column) -> Column:
        _, a, b, c = (r[n] for n in names)
        v, w = _triangle_weights(*[d[f"d{i}"] for i in range(1, 7)])
        at = lambda k: add(a, add(scale(sub(b, a), k["v"]), scale(sub(c, a), k["w"])))
        return let(F.struct(v.alias("v"), w.alias("w")), at)

    return let(F.struct(p.alias("p"), a.alias("a"), b.alias("b"), c.alias("c")), products)


def _triangle_weights(d1: Column, d2: Column, d3: Column, d4: Column, d5: Column, d6: Column) -> tuple[Column, Column]:
    """Weights of b and c in the closest point; the corner a has the rest."""
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    v = F.when((d1 <= 0) & (d2 <= 0), 0.0).when((d3 >= 0) & (d4 <= d3), 1.0).when((vc <= 0) & (d1 >= 0) & (d3 <= 0), d1 / (d1 - d3))
    w = F.when((d1 <= 0) & (d2 <= 0), 0.0).when((d3 >= 0) & (d4 <= d3), 0.0).when((vc <= 0) & (d1 >= 0) & (d3 <= 0), 0.0)
    v = v.when((d6 >= 0) & (d5 <= d6), 0.0).when((vb <= 0) & (d2 >= 0) & (d6 <= 0), 0.0)
    w = w.when((d6 >= 0) & (d5 <= d6), 1.0).when((vb <= 0) & (d2 >= 0) & (d6 <= 0), d2 / (d2 - d6))
    along, on = (d4 - d3) / ((d4 - d3) + (d5 - d6)), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)
    v = v.when(on, 1 - along).otherwise(vb / (va + vb + vc))
    w = w.when(on, along).otherwise(vc / (va + vb + vc))
    return v, w


def with_closest_on_triangle(rows: DataFrame, p: Column, a: Column, b: Column, c: Column) -> DataFrame:
    """rows with closest_on_triangle as point, by columns of plain numbers, for tables of very many pairs."""
    names = rows.columns
    ab, ac = sub(b, a), sub(c, a)
    d = [dot(side, sub(p, corner)) for corner in (a, b, c) for side in (ab, ac)]
    rows = rows.withColumns({f"_d{i + 1}": x for i, x in enumerate(d)})
    v, w = _triangle_weights(*[F.col(f"_d{i}") for i in range(1, 7)])
    rows = rows.withColumns({"_v": v, "_w": w})
    return rows.select(*names, add(a, add(scale(ab, F.col("_v")), scale(ac, F.col("_w")))).alias("point"))


#: Where a line, a ray and a segment end, along a direction from their origin.
_ENDS = {"line": (float("-inf"), float("inf")), "ray": (0.0, float("inf")), "segment": (0.0, 1.0)}


def closest_of_lines(kind0: str, o0: Column, d0: Column, kind1: str, o1: Column, d1: Column) -> Column:
    """struct<p, q, d2>: the closest points of two of line, ray and segment, each by an origin and a direction (a segment's end is origin + direction).

    One solve for both parameters, each clamped to where its primitive ends.
    Parallel ones and such without a length count from the first one's origin.
    """
    (low0, high0), (low1, high1) = _ENDS[kind0], _ENDS[kind1]

    def products(r: Column) -> Column:
        u, v, w = r["u"], r["v"], sub(r["a"], r["c"])
        pairs = {"uu": (u, u), "uv": (u, v), "vv": (v, v), "uw": (u, w), "vw": (v, w)}
        return let(F.struct(*[dot(*x).alias(n) for n, x in pairs.items()]), lambda k: first(r, k))

    def first(r: Column, k: Column) -> Column:
        den = k["uu"] * k["vv"] - k["uv"] * k["uv"]
        alone = F.when((k["vv"] <= 0) & (k["uu"] > 0), _clamp(-k["uw"] / k["uu"], low0, high0)).otherwise(0.0)
        s = F.when(den > EPS2 * k["uu"] * k["vv"], _clamp((k["uv"] * k["vw"] - k["vv"] * k["uw"]) / den, low0, high0)).otherwise(alone)
        return let(s, lambda s: let(F.when(k["vv"] > 0, (k["uv"] * s + k["vw"]) / k["vv"]).otherwise(0.0), lambda t: both(r, k, s, t)))

    def both(r: Column, k: Column, s: Column, t: Column) -> Column:
        t1 = _clamp(t, low1, high1)
        s1 = F.when(t == t1, s).otherwise(F.when(k["uu"] > 0, _clamp((k["uv"] * t1 - k["uw"]) / k["uu"], low0, high0)).otherwise(0.0))
        p, q = add(r["a"], scale(r["u"], s1)), add(r["c"], scale(r["v"], t1))
        return let(F.struct(p.alias("p"), q.alias("q")), lambda e: F.struct(e["p"].alias("p"), e["q"].alias("q"), distance2(e["p"], e["q"]).alias("d2")))

    return let(F.struct(o0.alias("a"), d0.alias("u"), o1.alias("c"), d1.alias("v")), products)


def closest_of_segments(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<p, q, d2> for segments a b and c d."""
    return closest_of_lines("segment", a, sub(b, a), "segment", c, sub(d, c))


def closest_in_polygon(p: Column, pts: Column) -> Column:
    """The point of a flat polygon, an array of points in order, that comes closest to p."""

    def place(r: Column) -> Column:
        ends = F.zip_with(r["pts"], F.concat(F.slice(r["pts"], F.lit(2), F.size(r["pts"])), F.slice(r["pts"], F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        near = F.transform(ends, lambda e: closest_on_segment(r["p"], e["a"], e["b"]))
        side = F.array_min(F.transform(near, lambda q: F.struct(distance2(r["p"], q).alias("d2"), q.alias("q"))))["q"]
        foot = let(dot(sub(r["p"], F.get(r["pts"], F.lit(0))), r["n"]), lambda h: sub(r["p"], scale(r["n"], h)))
        return let(foot, lambda f: F.when(r["n"].isNotNull() & (point_in_polygon(f, r["pts"]) != "outside"), f).otherwise(side))

    return let(F.struct(p.alias("p"), pts.alias("pts")), lambda r: let(newell(r["pts"]), lambda n: let(F.struct(r["p"].alias("p"), r["pts"].alias("pts"), normalized(n).alias("n")), place)))


def segment_box_distance2(a: Column, b: Column, low: Column, high: Column) -> Column:
    """Zero where the segment meets the solid box; else from its ends to the box or from it to the box's edges."""
    edges = [(i, i | 1 << k) for i in range(8) for k in range(3) if not i >> k & 1]

    def placed(r: Column) -> Column:
        corner = lambda i: F.struct(*[r["high" if i >> k & 1 else "low"][x].alias(x) for k, x in enumerate(AXES)])
        ends = F.array(*[F.struct(corner(i).alias("c"), corner(j).alias("d")) for i, j in edges])
        sides = F.array_min(F.transform(ends, lambda e: closest_of_segments(r["a"], r["b"], e["c"], e["d"])["d2"]))
        nearest = F.transform(F.array(r["a"], r["b"]), lambda p: let(closest_in_box(p, r["low"], r["high"]), lambda q: distance2(p, q)))
        hit = ray_box(r["a"], r["u"], r["low"], r["high"], 0.0, 1.0)["status"] == "intersection"
        return F.when(hit, 0.0).otherwise(F.least(sides, F.array_min(nearest)))

    return let(F.struct(a.alias("a"), b.alias("b"), low.alias("low"), high.alias("high"), sub(b, a).alias("u")), placed)


def distance2(p: Column, q: Column) -> Column:
    return length2(sub(p, q))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(distance2(p, q))


def plane_distance(p: Column, n: Column, d) -> Column:
    """Signed."""
    return dot(n, p) + d


def sphere_distance(p: Column, centre: Column, radius) -> Column:
    """To the surface, zero inside."""
    return F.greatest(F.lit(0.0), distance(p, centre) - radius)


def box_box_distance2(low0: Column, high0: Column, low1: Column, high1: Column) -> Column:
    gap = each(lambda a, b, c, d: F.greatest(F.lit(0.0), c - b, a - d), low0, high0, low1, high1)
    return length2(gap)


def box_plane_distance(low: Column, high: Column, n: Column, d) -> Column:
    """Zero where they meet."""
    middle, half = scale(add(low, high), 0.5), scale(sub(high, low), 0.5)
    reach = F.abs(n["x"]) * half["x"] + F.abs(n["y"]) * half["y"] + F.abs(n["z"]) * half["z"]
    return F.greatest(F.lit(0.0), F.abs(plane_distance(middle, n, d)) - reach)


# Sides, containment and intersection.


def _side(value: Column, on: str = "on_boundary") -> Column:
    return F.when(value > EPS, "on_positive_side").when(value < -EPS, "on_negative_side").otherwise(on)


def classify_plane(p: Column, n: Column, d) -> Column:
    return _side(plane_distance(p, n, d))


def _cross2(o: Column, d: Column, p: Column) -> Column:
    return d["x"] * (p["y"] - o["y"]) - d["y"] * (p["x"] - o["x"])


def classify_line2d(p: Column, origin: Column, direction: Column) -> Column:
    return _side(_cross2(origin, direction, p))


def classify_ray2d(p: Column, origin: Column, direction: Column) -> Column:
    """On the line but before the origin counts as the negative side."""
    before = dot(sub(p, origin), direction) < -EPS
    return F.when((F.abs(_cross2(origin, direction, p)) <= EPS) & before, "on_negative_side").otherwise(classify_line2d(p, origin, direction))


def classify_segment2d(p: Column, a: Column, b: Column) -> Column:
    """On the line but past an end counts as the negative side."""
    d = sub(b, a)
    past = (dot(sub(p, a), d) < -EPS) | (dot(sub(p, b), d) > EPS)
    return F.when((F.abs(_cross2(a, d, p)) <= EPS) & past, "on_negative_side").otherwise(classify_line2d(p, a, d))


def point_in_polygon2d(p: Column, pts: Column) -> Column:
    """inside, outside or on_boundary for an array of points in order, by the winding number."""
    n = F.size(pts)

    def step(state: Column, i: Column) -> Column:
        a, b = F.get(pts, i), F.get(pts, (i + 1) % n)
        side = (b["x"] - a["x"]) * (p["y"] - a["y"]) - (p["x"] - a["x"]) * (b["y"] - a["y"])
        between = (p["x"] >= F.least(a["x"], b["x"]) - EPS) & (p["x"] <= F.greatest(a["x"], b["x"]) + EPS) & (p["y"] >= F.least(a["y"], b["y"]) - EPS) & (p["y"] <= F.greatest(a["y"], b["y"]) + EPS)
        turn = F.when((a["y"] <= p["y"]) & (b["y"] > p["y"]) & (side > 0), 1).when((a["y"] > p["y"]) & (b["y"] <= p["y"]) & (side < 0), -1).otherwise(0)
        return F.struct((state["w"] + turn).alias("w"), (state["on"] | ((F.abs(side) <= EPS) & between)).alias("on"))

    start = F.struct(F.lit(0).alias("w"), F.lit(False).alias("on"))
    out = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
    return F.when(out["on"], "on_boundary").when(out["w"] != 0, "inside").otherwise("outside")


def point_in_polygon(p: Column, pts: Column) -> Column:
    """point_in_polygon2d in the plane of a polygon in space: along the axis on which its area vector is longest."""

    def seen(r: Column) -> Column:
        size = {x: F.abs(r["n"][x]) for x in AXES}
        flat = lambda x, y: point_in_polygon2d(vec(r["p"][x], r["p"][y]), F.transform(r["pts"], lambda q: vec(q[x], q[y])))
        return F.when((size["z"] >= size["x"]) & (size["z"] >= size["y"]), flat("x", "y")).when(size["x"] >= size["y"], flat("y", "z")).otherwise(flat("z", "x"))

    return let(F.struct(p.alias("p"), pts.alias("pts")), lambda r: let(F.struct(r["p"].alias("p"), r["pts"].alias("pts"), newell(r["pts"]).alias("n")), seen))


def classify_wedge2d(p: Column, corner: Column, one: Column, other: Column) -> Column:
    """Sides of the wedge that turns left from the direction one to the direction other at its corner: within is the positive side, its rays are on_boundary."""

    def placed(r: Column) -> Column:
        turn, a, b = _cross2(vec(0, 0), r["u"], r["v"]), _cross2(vec(0, 0), r["u"], r["w"]), _cross2(vec(0, 0), r["w"], r["v"])
        on = ((F.abs(a) <= EPS) & (dot(r["u"], r["w"]) >= -EPS)) | ((F.abs(b) <= EPS) & (dot(r["v"], r["w"]) >= -EPS))
        # Up to half a turn a point is left of the first ray and right of the second; beyond, one of both will do.
        within = F.when(turn > 0, (a > 0) & (b > 0)).when((turn == 0) & (dot(r["u"], r["v"]) > 0), F.lit(False)).otherwise((a > 0) | (b > 0))
        return F.when(on, "on_boundary").when(within, "on_positive_side").otherwise("on_negative_side")

    return let(F.struct(one.alias("u"), other.alias("v"), sub(p, corner).alias("w")), placed)


def box_overlaps(low0: Column, high0: Column, low1: Column, high1: Column) -> Column:
    return reduce(lambda a, b: a & b, [(low0[a] <= high1[a]) & (low1[a] <= high0[a]) for a in AXES])


def box_holds(p: Column, low: Column, high: Column) -> Column:
    return reduce(lambda a, b: a & b, [(p[a] >= low[a]) & (p[a] <= high[a]) for a in AXES])


def segments_cross2d(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<s, t, x, y> where segments a b and c d meet in one point, null if they don't or run along one line."""
    r, q = sub(b, a), sub(d, c)
    den = r["x"] * q["y"] - r["y"] * q["x"]
    s = ((c["x"] - a["x"]) * q["y"] - (c["y"] - a["y"]) * q["x"]) / den
    t = ((c["x"] - a["x"]) * r["y"] - (c["y"] - a["y"]) * r["x"]) / den
    hit = (F.abs(den) > EPS2) & (s >= -EPS) & (s <= 1 + EPS) & (t >= -EPS) & (t <= 1 + EPS)
    return F.when(hit, F.struct(_clamp(s).alias("s"), _clamp(t).alias("t"), (a["x"] + s * r["x"]).alias("x"), (a["y"] + s * r["y"]).alias("y")))


def _hit(t: Column, ok: Column, origin: Column, direction: Column, min_t, max_t) -> Column:
    good = ok & (t >= min_t) & (t <= max_t)
    return F.struct(F.when(good, "intersection").otherwise("none").alias("status"), F.when(good, t).alias("t"), F.when(good, add(origin, scale(direction, t))).alias("point"))


def ray_plane(origin: Column, direction: Column, n: Column, d, min_t=0.0, max_t=float("inf")) -> Column:
    """struct<status, t, point>; coplanar and parallel rays have their own status."""
    slope, off = dot(n, direction), plane_distance(origin, n, d)
    t = -off / F.when(F.abs(slope) > EPS, slope)
    out = _hit(t, F.coalesce(F.abs(slope) > EPS, F.lit(False)), origin, direction, min_t, max_t)
    status = F.when(F.abs(slope) > EPS, out["status"]).when(F.abs(off) <= EPS, "coplanar").otherwise("parallel")
    return F.struct(status.alias("status"), out["t"].alias("t"), out["point"].alias("point"))


def ray_triangle(origin: Column, direction: Column, a: Column, b: Column, c: Column, min_t=0.0, max_t=float("inf")) -> Column:
    """struct<status, t, point> (Moeller-Trumbore)."""
    e1, e2, s = sub(b, a), sub(c, a), sub(origin, a)

    def hit(r: Column) -> Column:
        inv = 1 / F.when(F.abs(r["det"]) > EPS2, r["det"])
        u, v = r["u"] * inv, r["v"] * inv
        ok = F.coalesce((F.abs(r["det"]) > EPS2) & (u >= -EPS) & (v >= -EPS) & (u + v <= 1 + EPS), F.lit(False))
        return _hit(r["t"] * inv, ok, origin, direction, min_t, max_t)

    def products(r: Column) -> Column:
        h, q = cross(direction, r["e2"]), cross(r["s"], r["e1"])
        parts = {"det": dot(r["e1"], h), "u": dot(r["s"], h), "v": dot(direction, q), "t": dot(r["e2"], q)}
        return let(F.struct(*[x.alias(n) for n, x in parts.items()]), hit)

    return let(F.struct(e1.alias("e1"), e2.alias("e2"), s.alias("s")), products)


def ray_box(origin: Column, direction: Column, low: Column, high: Column, min_t=0.0, max_t=float("inf")) -> Column:
    """struct<status, t, point> of the entry, by slabs."""
    enter, leave = [F.lit(float(min_t))], [F.lit(float(max_t))]
    inside = F.lit(True)
    for a in AXES:
        flat = F.abs(direction[a]) <= EPS2
        inv = 1 / F.when(~flat, direction[a])
        t0, t1 = (low[a] - origin[a]) * inv, (high[a] - origin[a]) * inv
        enter.append(F.least(t0, t1))
        leave.append(F.greatest(t0, t1))
        inside &= ~flat | ((origin[a] >= low[a]) & (origin[a] <= high[a]))
    t, end = F.greatest(*enter), F.least(*leave)  # nulls of flat axes don't count
    return _hit(t, inside & (t <= end), origin, direction, min_t, max_t)


def ray_obb(origin: Column, direction: Column, corner: Column, axes: Sequence[Column], extent: Column, min_t=0.0, max_t=float("inf")) -> Column:
    """As ray_box, in the frame of a box with a corner, unit axes and extents."""
    local = lambda v: vec(*[dot(v, a) for a in axes])
    out = ray_box(local(sub(origin, corner)), local(direction), vec(0, 0, 0), extent, min_t, max_t)
    return F.struct(out["status"].alias("status"), out["t"].alias("t"), F.when(out["t"].isNotNull(), add(origin, scale(direction, out["t"]))).alias("point"))


def ray_segment2d(origin: Column, direction: Column, a: Column, b: Column, min_t=0.0, max_t=float("inf")) -> Column:
    q = sub(b, a)
    den = direction["x"] * q["y"] - direction["y"] * q["x"]
    inv = 1 / F.when(F.abs(den) > EPS2, den)
    t = ((a["x"] - origin["x"]) * q["y"] - (a["y"] - origin["y"]) * q["x"]) * inv
    s = ((a["x"] - origin["x"]) * direction["y"] - (a["y"] - origin["y"]) * direction["x"]) * inv
    return _hit(t, F.coalesce((s >= -EPS) & (s <= 1 + EPS), F.lit(False)), origin, direction, min_t, max_t)


# Polygons: arrays of points in order.


def newell(pts: Column) -> Column:
    """Twice the area vector: the sum of cross products of successive points."""
    n = F.size(pts)

    def step(s: Column, i: Column) -> Column:
        return add(s, cross(F.get(pts, i), F.get(pts, (i + 1) % n)))

    return F.aggregate(F.sequence(F.lit(0), n - 1), vec(0, 0, 0), step)


def area(pts: Column) -> Column:
    return length(newell(pts)) / 2


def area2(pts: Column) -> Column:
    """The square of the area."""
    return length2(newell(pts)) / 4


def signed_area2d(pts: Column) -> Column:
    return newell(pts)["z"] / 2


def face_normal(pts: Column) -> Column:
    """Of the first three points; null where they have no area."""
    a, b, c = (F.get(pts, F.lit(k)) for k in range(3))
    return normalized(cross(sub(b, a), sub(c, a)))


def centroid(pts: Column) -> Column:
    """The mean of the points."""
    return scale(F.aggregate(pts, vec(0, 0, 0), add), 1 / F.size(pts))


def _along_axis(pts: Column, a: str) -> Column:
    return F.transform(pts, lambda p: p[a])


def box_low(pts: Column) -> Column:
    return vec(*[F.array_min(_along_axis(pts, a)) for a in AXES])


def box_high(pts: Column) -> Column:
    return vec(*[F.array_max(_along_axis(pts, a)) for a in AXES])


def basis(n: Column) -> Column:
    """struct<u, v> that make a right-handed frame with a unit normal."""
    away = F.when(F.abs(n["x"]) < 0.9, vec(1, 0, 0)).otherwise(vec(0, 1, 0))
    u = normalized(cross(away, n))
    return F.struct(u.alias("u"), cross(n, u).alias("v"))
