"""Similarity join on word n-grams through a MinHash LSH forest.

Each text has a path of DEPTH minima in each of TREES tries. The sizes of the
nodes on all paths come from aggregates of the paths' sorted cells. Every row
starts from its full paths; the ones whose shorter prefix adds the fewest other
rows are shortened first, until the expected recall at the threshold reaches its
target, and the rows of the largest nodes meet by their long prefixes only.
Rows of one node are compared by their signatures there; what these link is
then verified exactly, in blocks, so no group has to fit a task and no pair is
written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components

from ._io import table, text_or_empty
from ._shingles import batches, mix, shingle_sets

WORDS = 5
TREES = 32
DEPTH = 8
#: A byte of every STRIDE-th minimum is kept to compare rows by.
STRIDE = 2


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that still finds the share recall of pairs at the threshold."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def prefix_lengths(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> list[int]:
    """The prefix of a row's tree by the tree's rank, from the one that gains most by a long prefix on.

    Each is as long as the expected share of found pairs at the threshold
    allows, the others after it as short as prefix_length().
    """
    low = prefix_length(threshold, recall, trees, depth)
    out = [low] * trees
    for r in range(trees):
        for k in range(depth, low, -1):
            tried = [*out[:r], k, *out[r + 1 :]]
            if 1 - np.prod([1 - threshold**x for x in tried]) >= recall:
                out = tried
                break
    return out


def minima(sets: list[np.ndarray], count: int, few: int = 1 << 15) -> np.ndarray:
    """(count, sets): the minimum of each set (none empty) under each hash."""
    times = np.random.default_rng(1).integers(1 << 31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low = np.zeros((count, len(sets)), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= few):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        for i, a in enumerate(times):
            y = x * a
            low[i, at:end] = np.minimum.reduceat(y ^ (y >> np.uint32(15)), starts)
        at = end
    return low


def paths(low: np.ndarray, trees: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set and tree: a key of the first k minima, and the rest of the path, one byte for each further minimum."""
    depth = len(low) // trees
    keys, rest = np.zeros((low.shape[1], trees), np.uint64), np.zeros((low.shape[1], trees), np.int64)
    for t in range(trees):
        key = np.full(low.shape[1], t + 1, np.uint64)
        for j in range(k):
            key = mix(key * np.uint64(31) + low[t * depth + j])
        keys[:, t] = key
        for j in range(k, depth):
            rest[:, t] = rest[:, t] << 8 | (mix(low[t * depth + j].astype(np.uint64)) & np.uint64(255)).astype(np.int64)
    return keys.view(np.int64), rest


def _read(docs: DataFrame, trees: int, k: int, text: str, doc_id: str, row: str | None) -> DataFrame:
    """rid, doc_id, t, n shingles, the set's 128-bit key, and keys, rests and bytes of minima (null without words)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(3).to_pylist()
            for at, part in batches(texts):
                sets = shingle_sets(part, WORDS)
                some = [i for i, s in enumerate(sets) if len(s)]
                low = minima([sets[i] for i in some], trees * DEPTH)
                rows: list[list] = [[None] * len(part) for _ in range(3)]
                for i, *own in zip(some, *paths(low, trees, k), mix(low[: trees * DEPTH : STRIDE].T.astype(np.uint64)).astype(np.uint8), strict=True):
                    for c, x in zip(rows, own, strict=True):
                        c[i] = x
                digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
                cols = [batch.column(c).slice(at, len(part)) for c in range(3)]
                cols += [pa.array([len(s) for s in sets], pa.int32()), pa.array([d[0] for d in digest]), pa.array([d[1] for d in digest])]
                cols += [pa.array(rows[0], pa.list_(pa.int64())), pa.array(rows[1], pa.list_(pa.int64())), pa.array([None if x is None else x.tobytes() for x in rows[2]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "t", "n", "s1", "s2", "keys", "rests", "sig"])

    t = text_or_empty(F.col(text))
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"), t.cast("binary").alias("b"))
    return rows.mapInArrow(run, "rid long, doc_id long, t string, n int, s1 long, s2 long, keys array<long>, rests array<long>, sig binary")


def _nodes(reps: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(rid, group): the rows of each node of the forest in which some row, its prefixes shortened to the target recall, meets others.

    Nodes with the same rows count once.
    """
    short = prefix_length(threshold, recall)
    of_rank = prefix_lengths(threshold, recall)
    up = lambda c, d: F.shiftright(c, 8 * (DEPTH - d))  # noqa: E731  the rest of a path of length d
    cells = reps.select("rid", F.explode(F.arrays_zip("keys", "rests")).alias("p")).select("rid", F.col("p.keys").alias("key"), F.col("p.rests").alias("rest"))
    prefixes = table(cells)
    most = prefixes.groupBy("key").agg(F.count("*").alias(f"m{short}")).where(F.col(f"m{short}") > 1)
    shared = table(prefixes.join(table(most).hint("merge"), "key"))  # both sides grow with the input
    cells = shared.groupBy("key", "rest").agg(F.count("*").alias(f"m{DEPTH}"), F.first(f"m{short}").alias(f"m{short}"))
    for d in range(short + 1, DEPTH):
        sums = cells.groupBy("key", up("rest", d).alias("r")).agg(F.sum(f"m{DEPTH}").alias(f"m{d}"))
        cells = cells.withColumn("r", up("rest", d)).join(sums, ["key", "r"]).drop("r")
    live = table(shared.drop(f"m{short}").join(table(cells).hint("merge"), ["key", "rest"]))
    # A row has a place in at most as many nodes as there are trees.
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc(F.col(f"m{short}") - F.col(f"m{DEPTH}")), "key"))
    length = F.element_at(F.array(*[F.lit(x) for x in of_rank]), rank)
    size = F.element_at(F.array(*[F.col(f"m{d}") for d in range(short, DEPTH + 1)]), F.col("d") - short + 1)
    asked = live.withColumn("d", length).where(size > 1).groupBy("key", "rest").agg(F.min("d").alias("d"))
    # A node that is asked for holds all cells below it.
    asked = table(asked)
    held = live.select("key", "rest").distinct().withColumn("d", F.lit(None).cast("int"))
    for d in range(DEPTH, short - 1, -1):
        here = asked.where(F.col("d") == d).select("key", up("rest", d).alias("r")).distinct().withColumn("_d", F.lit(d))
        held = held.withColumn("r", up("rest", d)).join(here, ["key", "r"], "left").withColumn("d", F.coalesce("_d", "d")).drop("r", "_d")
    held = held.where("d IS NOT NULL")
    path = F.element_at(F.array(*[up("rest", d) for d in range(short, DEPTH + 1)]), F.col("d") - short + 1)
    members = table(live.select("rid", "key", "rest").join(held, ["key", "rest"]).select("rid", F.xxhash64("key", "d", path).alias("group")))
    alike = members.groupBy("group").agg(F.count("*").alias("m"), F.sum(F.xxhash64("rid").cast("decimal(20,0)")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"), F.min("rid").alias("r")).where("m > 1")
    once = alike.groupBy("m", "x", "y", "r").agg(F.min("group").alias("group"))
    return members.join(once.select("group"), "group")


def agreements(sigs: np.ndarray) -> np.ndarray:
    """In how many places each pair of rows has the same byte."""
    out = np.zeros((len(sigs), len(sigs)), np.int32)
    step = max(1, (1 << 22) // max(1, sigs.size))
    for a in range(0, len(sigs), step):
        out[a : a + step] = (sigs[a : a + step, None] == sigs[None]).sum(2, dtype=np.int32)
    return out


def _near(threshold: float) -> Callable[[list[bytes]], np.ndarray]:
    """Which pairs of signatures may belong to sets that reach the threshold: estimates up to six standard errors below it count."""
    size = TREES * DEPTH // STRIDE
    least = (threshold - 6 * (threshold * (1 - threshold) / size) ** 0.5) * size

    def run(sigs: list[bytes]) -> np.ndarray:
        return agreements(np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)) >= least

    return run


def _exactly(threshold: float) -> Callable[[list[bytes]], np.ndarray]:
    """Which pairs of texts reach the threshold."""

    def run(texts: list[bytes]) -> np.ndarray:
        sets = shingle_sets(texts, WORDS)
        size = np.array([len(s) for s in sets], float)
        both = overlaps(sets)
        return both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9

    return run


def overlaps(sets: list[np.ndarray], width: int = 1 << 14) -> np.ndarray:
    """How many hashes each pair of sets shares."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    codes, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inv]
    owner, name = owner[name >= 0], name[name >= 0]
    order = np.argsort(name, kind="stable")
    owner, name = owner[order], name[order]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, int(name[-1]) + 1 if len(name) else 0, width):
        a, b = np.searchsorted(name, [low, low + width])
        m = np.zeros((len(sets), min(width, int(name[-1]) + 1 - low)), np.float32)
        m[owner[a:b], name[a:b] - low] = 1
        out += m @ m.T
    return out


def _forest(pairs: np.ndarray, known: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs connect, beyond what the known ones do."""
    up, out = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for given, rows in ((True, known), (False, pairs)):
        for a, b in rows.tolist():
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                if not given:
                    out.append((a, b))
    return out


def _compared(members: DataFrame, alike: Callable[[list[bytes]], np.ndarray], block: int) -> DataFrame:
    """(node, links, joins) from members (group, node, t): partial counts of alike pairs, and links that connect what they do in each block pair.

    A group of up to block members is one task's work; larger ones are dealt
    into blocks, and every pair of blocks is a unit of work of its own.
    """
    blocks = table(members.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    dealt = members.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", F.col("t").cast("binary").alias("t")
    )

    def unit(i: int, j: int, own: np.ndarray, node: np.ndarray, texts: list[bytes]) -> list[tuple]:
        like = alike(texts)
        np.fill_diagonal(like, False)
        inner = np.zeros((0, 2), int)
        if i != j:  # links inside either block come from that block's own unit
            across = own[:, None] != own[None, :]
            inner, like = np.argwhere(np.triu(like & ~across)), like & across
        links = like.sum(1)
        joins: list[list[int]] = [[] for _ in node]
        for a, b in _forest(np.argwhere(np.triu(like)), inner, len(node)):
            joins[a].append(int(node[b]))
        return [(int(n), int(k), x) for n, k, x in zip(node, links, joins, strict=True) if k]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], ["node", "links", "joins"])

        held, key, out = [], None, []
        for batch in parts:
            for g, i, j, own, node, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (g, i, j):
                    if len(held) > 1:
                        out += unit(*key[1:], *map(np.array, list(zip(*held, strict=True))[:2]), [h[2] for h in held])
                    held, key = [], (g, i, j)
                held.append((own, node, t))
            if out:
                yield found(out)
                out = []
        if len(held) > 1:
            yield found(unit(*key[1:], *map(np.array, list(zip(*held, strict=True))[:2]), [h[2] for h in held]))

    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(run, "node long, links long, joins array<long>")


def jaccard_join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, text: str = "text", doc_id: str = "doc_id", block: int = 64, row: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, rep_id, n_links, n_shingles, first.

    row names a column of distinct whole numbers, which the result then has too.
    Texts link when the Jaccard similarity of their sets of five-word shingles
    is at least threshold. rep_id is the smallest doc_id with the same set,
    n_links the number of other sets that link to the row's, class_id the
    smallest doc_id among all that links connect; first marks one row of each
    class, one with that doc_id. Texts of one to four words have all their words
    as one shingle; null texts and texts without words link to nothing, are
    classes of their own (rep_id and class_id their doc_id), and are first.
    Null doc_ids come last in the order; repeated rows share a class. Texts of
    any length count whole, an empty table gives an empty result, and other
    columns take no part.
    """
    read = table(_read(docs, TREES, prefix_length(threshold, recall), text, doc_id, row))
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    full = read.where("n > 0")
    sets = table(full.groupBy("s1", "s2", "n").agg(F.min(order).alias("k")).select("s1", "s2", "n", F.col("k.r").alias("rep"), F.col("k.d").alias("rep_id")))
    rows = table(full.select("rid", "doc_id", "s1", "s2", "n").join(sets.hint("merge"), ["s1", "s2", "n"]).select("rid", "doc_id", "n", "rep", "rep_id"))
    reps = full.select("rid", "keys", "rests").join(sets.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi")
    nodes = table(_nodes(reps, threshold, recall))
    signed = nodes.hint("merge").join(full.select("rid", "sig"), "rid").select("group", F.col("rid").alias("node"), F.col("sig").alias("t"))
    likely = table(_compared(signed, _near(threshold), 16 * block))
    groups = table(connected_components(likely.select("node", F.explode("joins").alias("to")), "node", "to"))
    members = full.select(F.col("rid").alias("node"), "t").join(groups.withColumnRenamed("label", "group"), "node")
    links = table(_compared(members, _exactly(threshold), block))
    near = connected_components(links.select("node", F.explode("joins").alias("to")), "node", "to")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = table(near.join(counts, "node").join(rows.where("rid = rep").select(F.col("rid").alias("node"), "rep_id"), "node"))
    first = F.min(F.struct(F.col("rep_id").isNull().alias("x"), F.col("rep_id").alias("d"), F.col("node").alias("r")))
    heads = table(linked.groupBy("label").agg(first.alias("k")))
    linked = table(linked.join(heads, "label").select(F.col("node").alias("rep"), "n_links", F.col("k.d").alias("class_id"), F.col("k.r").alias("head"), F.lit(True).alias("_in")))
    inside = F.coalesce("_in", F.lit(False))
    out = rows.join(linked, "rep", "left").select(
        "doc_id",
        F.when(inside, F.col("class_id")).otherwise(F.col("rep_id")).alias("class_id"),
        "rep_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        (F.col("rid") == F.when(inside, F.col("head")).otherwise(F.col("rep"))).alias("first"),
        "rid",
    )
    alone = read.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"), F.col("n").alias("n_shingles"), F.lit(True).alias("first"), "rid")
    out = out.unionByName(alone)
    return out.withColumnRenamed("rid", row) if row else out
