"""Ternary search trees over dictionary-encoded symbols: one shard of a trie of sorted paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence


class Shard:
    """A trie of the distinct paths of one range shard, with one search tree of siblings under each node."""

    def __init__(self, codes: dict[bytes, int]):
        self.codes = codes
        self.symbol, self.low, self.high, self.first = [-1], [-1], [-1], [-1]
        self.parent, self.name, self.size = [-1], [b""], [0]

    def child(self, node: int, name: bytes, size: int) -> int:
        """The child of a node for a symbol, made where there is none."""
        code, at, above = self.codes[name], self.first[node], -1
        while at >= 0 and self.symbol[at] != code:
            above, at = at, self.low[at] if code < self.symbol[at] else self.high[at]
        if at >= 0:
            return at
        at = len(self.symbol)
        if above < 0:
            self.first[node] = at
        elif code < self.symbol[above]:
            self.low[above] = at
        else:
            self.high[above] = at
        for column, value in ((self.symbol, code), (self.low, -1), (self.high, -1), (self.first, -1), (self.parent, node), (self.name, name), (self.size, size)):
            column.append(value)
        return at

    def insert(self, path: Sequence[tuple[bytes, int]]) -> int:
        node = 0
        for name, size in path:
            node = self.child(node, name, size)
        return node


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each range before its halves, so that sorted paths make balanced trees."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            todo += [(mid + 1, b), (a, mid)]


def grow(trie: str, paths: list[list[tuple[bytes, int]]], rows: list[tuple], first: bool, last: bool) -> Iterator[tuple]:
    """Nodes of one trie in one shard, top first.

    rows, one for each path: n, least, ends, open, o_children, o_leaves, o_saved.
    first and last: earlier or later shards may hold paths of this trie too, so
    the nodes along the first or last path are edges, whose sums are partial:
    they leave out what lies under edges. Yields depth, edge, key, parent_key, path,
    size, least, parent_least, n, children, leaves, saved, ends, open, o_children.
    """
    shard = Shard({s: i for i, s in enumerate(sorted({s for p in paths for s, _ in p}))})
    end = [0] * len(paths)
    for i in medians(len(paths)):
        end[i] = shard.insert(paths[i])
    count = len(shard.symbol)
    n, least, children, leaves, saved = [0] * count, [None] * count, [0] * count, [0] * count, [0] * count
    ends, open_, o_children = [None] * count, [False] * count, [0] * count
    edge = [False] * count
    for i in ([0] if first else []) + ([len(paths) - 1] if last else []):
        at = end[i]
        while at >= 0:
            edge[at], at = True, shard.parent[at]
    for at, (k, c, e, o, oc, ol, os_) in zip(end, rows, strict=True):
        n[at] += k
        least[at] = c if least[at] is None else min(c, least[at])
        ends[at] = e if e is not None else ends[at]
        if o:
            open_[at], o_children[at] = True, oc
            leaves[at] += ol
            saved[at] += os_
    depth = [0] * count
    for at in range(1, count):
        depth[at] = depth[shard.parent[at]] + 1
    for at in range(count - 1, -1, -1):  # a node is made after its parent
        up = shard.parent[at]
        if not edge[at]:
            if not children[at] and not open_[at]:
                leaves[at] = 1
            saved[at] += (n[at] - 1) * shard.size[at]
        if up >= 0:
            n[up] += n[at]
            least[up] = least[at] if least[up] is None else min(least[at], least[up])
            if not edge[at]:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
    key: dict[int, list[str]] = {}
    for at in range(count):
        up = shard.parent[at]
        if edge[at]:
            above = key[up] if up >= 0 else []
            text = above[-1].encode() + shard.name[at] if above else b"root " + trie.encode()
            key[at] = [*above, hashlib.sha256(text).hexdigest()[:32]]
        over = up >= 0 and edge[up]
        yield (
            depth[at], edge[at], key[at][-1] if edge[at] else None, key[up][-1] if over else None, key.get(at), shard.size[at], least[at],
            None if over or up < 0 else least[up], n[at], children[at], leaves[at], saved[at], ends[at], open_[at], o_children[at],
        )
