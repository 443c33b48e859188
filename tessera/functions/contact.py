"""Numpy arithmetic on batches of triangle pairs: whether they meet, and where they come closest.

Triangles are arrays (k, 3, 3). Points and segments are triangles with equal
corners, and go through the same arithmetic.
"""

from __future__ import annotations

import numpy as np


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(-1)


def meets(a: np.ndarray, b: np.ndarray, slack: float = 1e-12) -> np.ndarray:
    """Which pairs share a point: no axis separates them. Pairs in one plane, points and segments included; touching counts."""
    ea, eb = np.roll(a, -1, 1) - a, np.roll(b, -1, 1) - b
    na, nb = np.cross(ea[:, 0], ea[:, 1]), np.cross(eb[:, 0], eb[:, 1])
    row = np.arange(len(a))
    la, lb = (e[row, _dot(e, e).argmax(1)] for e in (ea, eb))
    both = np.cross(la, lb)
    flat_a, flat_b = (_dot(n, n)[:, None] <= 0 for n in (na, nb))
    pa = np.where(flat_a, np.where(flat_b, both, nb), na)
    pb = np.where(flat_b, np.where(flat_a, both, na), nb)
    gap = a[:, 0] - b[:, 0]
    axes = [na, nb, both, gap, la, lb, np.cross(la, np.cross(gap, la)), np.cross(lb, np.cross(gap, lb))]
    for i in range(3):
        axes += [np.cross(pa, ea[:, i]), np.cross(pb, eb[:, i]), np.cross(pa, eb[:, i]), np.cross(pb, ea[:, i])]
        axes += [np.cross(ea[:, i], eb[:, j]) for j in range(3)]
    apart = np.zeros(len(a), bool)
    size = np.maximum(np.abs(a).max((1, 2)), np.abs(b).max((1, 2)))
    for axis in axes:
        x, y = _dot(a, axis[:, None]), _dot(b, axis[:, None])
        reach = slack * np.sqrt(_dot(axis, axis)) * np.maximum(size, 1e-300)
        apart |= (x.min(1) - y.max(1) > reach) | (y.min(1) - x.max(1) > reach)
    return ~apart


def _segments(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest points of segments a b and c d."""
    u, v, w = b - a, d - c, a - c
    uu, uv, vv, uw, vw = _dot(u, u), _dot(u, v), _dot(v, v), _dot(u, w), _dot(v, w)
    den = uu * vv - uv * uv
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(den > 1e-14 * uu * vv, np.clip((uv * vw - vv * uw) / den, 0, 1), np.where((vv <= 0) & (uu > 0), np.clip(-uw / uu, 0, 1), 0.0))
        t = np.where(vv > 0, (uv * s + vw) / vv, 0.0)
        t1 = np.clip(t, 0, 1)
        s = np.where(t == t1, s, np.where(uu > 0, np.clip((uv * t1 - uw) / uu, 0, 1), 0.0))
    return a + s[..., None] * u, c + t1[..., None] * v


def _over(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which points (k, n, 3), in the plane of triangles (k, 3, 3) or moved into it, lie in them."""
    n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])[:, None]
    inside = np.broadcast_to(_dot(n, n) > 0, p.shape[:2]).copy()
    for i in range(3):
        a, b = t[:, i, None], t[:, (i + 1) % 3, None]
        inside &= _dot(np.cross(b - a, p - a), n) >= 0
    return inside


def closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d2, p, q): the closest points of each pair, p on a and q on b; d2 is 0 where they meet.

    Two triangles come closest at two sides, at a corner and a face, or where a side goes through the other's face.
    """
    k = len(a)
    na, nb = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) for t in (a, b))
    p, q = _segments(*(np.broadcast_to(x, (k, 3, 3, 3)) for x in (a[:, :, None], np.roll(a, -1, 1)[:, :, None], b[:, None], np.roll(b, -1, 1)[:, None])))
    ps, qs, ds = [p.reshape(k, 9, 3)], [q.reshape(k, 9, 3)], [_dot(p - q, p - q).reshape(k, 9)]
    for t, other, n, swap in ((a, b, nb, False), (b, a, na, True)):
        nn = np.maximum(_dot(n, n), 1e-300)[:, None]
        h = _dot(t - other[:, :1], n[:, None])
        foot = t - (h / nn)[..., None] * n[:, None]
        end, he = np.roll(t, -1, 1), np.roll(h, -1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            through = t + np.where(h * he < 0, h / (h - he), 0.0)[..., None] * (end - t)
        for x, y, ok in ((t, foot, _over(foot, other)), (through, through, (h * he < 0) & _over(through, other))):
            ps.append(y if swap else x)
            qs.append(x if swap else y)
            ds.append(np.where(ok, _dot(x - y, x - y), np.inf))
    d = np.concatenate(ds, 1)
    best, row = d.argmin(1), np.arange(k)
    return d[row, best], np.concatenate(ps, 1)[row, best], np.concatenate(qs, 1)[row, best]
