"""Hashed words and word shingles of many texts at once.

A word is a run of bytes without ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _BACK)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(edge, hash, start, end) of all words: text t has the words edge[t]:edge[t + 1].

    start and end are byte places within the word's text.
    """
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    begin = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    white = _WHITE[data]
    s = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    e = np.flatnonzero(~white[:-1] & white[1:]) + 1
    up, back = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
    edge = np.append(np.searchsorted(s, begin), len(s))
    first = np.repeat(begin, np.diff(edge))
    return edge, h, s - first, e - first


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place on; len(h) - n + 1 of them."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out = mix(out + h[k : k + size])
    return out


def long_runs(h: np.ndarray, n: int) -> np.ndarray:
    """As runs, with other hashes and about 2 log2(n) steps."""
    part, size, out, done = h, 1, None, 0
    while done < n:
        if n & size:  # out: the first done words of each run
            out = part if out is None else mix(out[: max(0, len(out) - size)] * _R + part[done:])
            done += size
        part, size = mix(part[: max(0, len(part) - size)] * _R + part[size:]), size * 2
    return out


def batches(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in runs of about most bytes, with the number of the first; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; all its words together if it has fewer, none if it has none."""
    edge, h, _, _ = words(texts)
    every = runs(h, n)
    out = []
    for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        out.append(np.unique(every[a : b - n + 1]) if b - a >= n else runs(h[a:b], b - a) if b > a else every[:0])
    return out
