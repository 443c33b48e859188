"""Hashed character n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(1 << 16)])


def groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about most characters, with the number of the first; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-case texts with 0 for all but letters and digits, and the text of each.

    Two zeros stand before each text and after the last.
    """
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n\n" + "\n\n".join(low) + "\n\n").encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])
    owner = np.append(owner, np.full(2, max(0, len(low) - 1)))
    keep = (points >= 1 << 16) | _letters()[np.minimum(points, (1 << 16) - 1)]
    return np.where(keep, points, 0).astype(np.uint64), owner


def hashed(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of the n code points from each place on."""
    size = len(points) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = (h + points[k : k + size]) * _P
    return ((h ^ (h >> np.uint64(29))) * _P >> np.uint64(64 - bits)).astype(np.int64)
