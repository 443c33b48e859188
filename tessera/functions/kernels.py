"""Numpy arithmetic for one group or one row, used inside Spark tasks."""

from __future__ import annotations

import numpy as np

from tessera.model import EPS


def rigid(h: np.ndarray, mean_x: np.ndarray, mean_y: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """The 4x4 matrix of the best rotation for a cross-covariance x to y, with the means matched."""
    u, _, vt = np.linalg.svd(h)
    turn = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    m = np.eye(4)
    m[:3, :3] = scale * vt.T @ turn @ u.T
    m[:3, 3] = mean_y - m[:3, :3] @ mean_x
    return m


def rotation_stretch(h: np.ndarray) -> float:
    """Sum of the singular values, with the sign that keeps a rotation."""
    u, s, vt = np.linalg.svd(h)
    return float(s @ [1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])


def small_rotation(w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A rotation by the vector w, then a move by t."""
    n = np.linalg.norm(w)
    m = np.eye(4)
    if n > 0:
        x, y, z = w / n
        k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        m[:3, :3] += np.sin(n) * k + (1 - np.cos(n)) * k @ k
    m[:3, 3] = t
    return m


def ear_clip(pts: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon in space, projected along its area vector."""
    n = len(pts)
    normal = np.cross(pts, np.roll(pts, -1, 0)).sum(0)
    drop = int(np.abs(normal).argmax())
    q = np.delete(pts, drop, 1)
    if normal[drop] * (-1 if drop == 1 else 1) < 0:
        q = q[:, ::-1]
    left, out = list(range(n)), []

    def turn(a: int, b: int, c: int) -> float:
        return (q[b, 0] - q[a, 0]) * (q[c, 1] - q[a, 1]) - (q[b, 1] - q[a, 1]) * (q[c, 0] - q[a, 0])

    while len(left) > 3:
        best = None
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            size = turn(a, b, c)
            if size <= 0:
                continue
            if any(turn(a, b, p) >= 0 and turn(b, c, p) >= 0 and turn(c, a, p) >= 0 for p in left if p not in (a, b, c) and not any((q[p] == q[v]).all() for v in (a, b, c))):
                continue
            best = k
            break
        if best is None:  # nothing but flat corners is left
            best = max(range(len(left)), key=lambda k: -abs(turn(left[k - 1], left[k], left[(k + 1) % len(left)])))
        a, b, c = left[best - 1], left[best], left[(best + 1) % len(left)]
        out.append((a, b, c))
        left.pop(best)
    return [*out, tuple(left)] if len(left) == 3 else out


def clip(pts: list[tuple[float, ...]], values: list[float], level: float, above: bool) -> tuple[list[tuple[float, ...]], list[float]]:
    """The part of a polygon where values, linear along its sides, lie above (or below) a level."""
    out_p, out_v, n = [], [], len(pts)
    for i in range(n):
        p, q, a, b = pts[i], pts[(i + 1) % n], values[i], values[(i + 1) % n]
        inside, then = (a >= level, b >= level) if above else (a <= level, b <= level)
        if inside:
            out_p.append(p)
            out_v.append(a)
        if inside != then and a != b and level not in (a, b):
            # From the lower end, so that both faces of a side get the same point.
            (u, x), (v, y) = sorted([(a, p), (b, q)])
            t = (level - u) / (v - u)
            out_p.append(tuple(c + t * (d - c) for c, d in zip(x, y, strict=True)))
            out_v.append(level)
    return out_p, out_v


def has_area(pts: list[tuple[float, ...]]) -> bool:
    """Whether a polygon's area vector is other than 0."""
    x = y = z = 0.0
    for (a, b, c), (d, e, f) in zip(pts, [*pts[1:], pts[0]], strict=True):
        x, y, z = x + (b * f - c * e), y + (c * d - a * f), z + (a * e - b * d)
    return x * x + y * y + z * z > 0


def _spans(t: np.ndarray, n: np.ndarray, o: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of triangles (k, 3, 3) and planes with normals n through o: the ends of what both share, and their places along a direction."""
    d = np.einsum("kij,kj->ki", t - o[:, None], n)
    d[np.abs(d) < EPS] = 0
    e = np.roll(d, -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = t + (np.roll(t, -1, 1) - t) * (d / (d - e))[:, :, None]
    ends = np.concatenate([t, cross], 1)
    real = np.concatenate([d == 0, d * e < 0], 1)
    ends = np.where(real[:, :, None], ends, 0.0)
    k = np.einsum("kij,kj->ki", ends, along)
    low, high = np.where(real, k, np.inf).argmin(1), np.where(real, k, -np.inf).argmax(1)
    row = np.arange(len(t))
    empty = real.sum(1) < 2
    return ends[row, low], ends[row, high], np.where(empty, np.inf, k[row, low]), np.where(empty, -np.inf, k[row, high])


def triangle_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs of triangles (k, 3, 3) share a segment, and its ends: not those that share a plane or touch in a point."""
    na, nb = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (a, b))
    la, lb = np.linalg.norm(na, axis=1), np.linalg.norm(nb, axis=1)
    na, nb = na / np.maximum(la, 1e-300)[:, None], nb / np.maximum(lb, 1e-300)[:, None]
    # Most pairs share nothing: one triangle lies on one side of the other's plane.
    apart = np.zeros(len(a), bool)
    for t, o, n in ((a, b, nb), (b, a, na)):
        d = np.einsum("kij,kj->ki", t - o[:, None, 0], n)
        apart |= (d >= EPS).all(1) | (d <= -EPS).all(1)
    near = np.flatnonzero(~apart)
    a, b, na, nb, la, lb = (x[near] for x in (a, b, na, nb, la, lb))
    along = np.cross(na, nb)
    pa, qa, la0, la1 = _spans(a, nb, b[:, 0], along)
    pb, qb, lb0, lb1 = _spans(b, na, a[:, 0], along)
    low, high = np.where((la0 >= lb0)[:, None], pa, pb), np.where((la1 <= lb1)[:, None], qa, qb)
    ok = (la > 0) & (lb > 0) & (np.linalg.norm(along, axis=1) >= EPS) & (np.minimum(la1, lb1) - np.maximum(la0, lb0) > EPS)
    every = np.zeros(len(apart), bool)
    every[near] = ok
    ends = np.zeros((2, len(apart), 3))
    ends[:, near] = low, high
    return every, *ends
