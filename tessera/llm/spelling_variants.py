"""Grouping of spelling variants by dense prefix-suffix tiling.

Two words that differ by one inserted, deleted or replaced code point have a
common prefix and a common suffix that together reach the longer length minus
one. So they share the first half of the longer length, or else the rest of it:
words meet by such halves, sorted, and each task compares tiles of words as
padded matrices of code points, all pairs of a tile column by column. A half
that very many words share is cut into blocks, and each pair of blocks is a tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import table, text_or_empty

LETTERS = r"A-Za-zÀ-ÿ"
#: Words in a block, and code points of one tile's matrix, at most.
BLOCK, CELLS = 1024, 1 << 20
#: Words of several halves that are compared in one tile.
PACK = 384


def words(docs: DataFrame, min_chars: int = 7, min_count: int = 2, noise: int = 31, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n): words of min_chars code points and min_count occurrences at least.

    Words are maximal runs of Latin letters, A to Z in lower case. Where noise
    divides the CRC-32 h of "doc_id:word", the word loses its code point h % length.
    """
    run = F.explode(F.regexp_extract_all(text_or_empty(F.col(text)), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0)))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_d"), run.alias("_r")).select("_d", F.translate("_r", upper, upper.lower()).alias("_r"))
    h = F.crc32(F.concat("_d", F.lit(":"), "_r").cast("binary"))
    runs = runs.withColumn("_h", h)
    at = (F.col("_h") % F.length("_r")).cast("int")
    cut = F.concat(F.substring("_r", F.lit(1), at), F.substring("_r", at + 2, F.length("_r")))
    word = F.when(F.col("_h") % noise == 0, cut).otherwise(F.col("_r"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(found: DataFrame) -> DataFrame:
    """(word, n, longer, side, half): a word meets longer and equally long ones by the first half of the longer length and by the rest."""
    rows = found.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("longer"))
    k = F.shiftright("longer", 1)
    first = F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), k).alias("half"))
    rest = F.struct(F.lit(1).alias("side"), F.expr("right(word, longer - shiftright(longer, 1))").alias("half"))
    return rows.select("word", "n", "longer", F.explode(F.array(first, rest)).alias("_s")).select("word", "n", "longer", "_s.side", "_s.half")


def _tiled(rows: DataFrame, block: int) -> DataFrame:
    """rows with the tile (i, j) of each and its own block; a half with more words than a block is in several tiles."""
    room = F.greatest(F.lit(2), F.least(F.lit(block), F.floor(F.lit(CELLS) / F.col("longer")))).cast("int")
    hot = table(rows.groupBy("longer", "side", "half").agg(F.count("*").alias("_m")).where(F.col("_m") > room).withColumn("_blocks", F.ceil(F.col("_m") / room).cast("int")).drop("_m"))
    met = rows.join(hot, ["longer", "side", "half"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int"))
    met = met.withColumn("_o", F.explode(F.expr("sequence(0, _blocks - 1)")))
    return met.select("longer", "side", "half", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "word", "n")


def matrix(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of texts, padded by zeros at the end and at the start, and their lengths."""
    size = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if len(points) and points.max() < 256:
        points = points.astype(np.uint8)
    row, at = np.repeat(np.arange(len(texts)), size), np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    left, right = np.zeros((2, width, len(texts)), points.dtype)
    left[at, row] = points
    right[width - size[row] + at, row] = points
    return left, right, size


def near(a: list[str], b: list[str] | None, longer: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that differ by a single edit; b None: pairs within a, both ways.

    The longer one of a pair has longer code points; pairs that share the first
    half are those of side 0, all others of side 1.
    """
    (la, ra, sa), (lb, rb, sb) = (both := matrix(a, longer)), both if b is None else matrix(b, longer)
    step, out = max(1, CELLS // max(1, len(sb))), []
    for at in range(0, len(sa), step):
        rows = slice(at, at + step)
        common = []
        for x, y in ((la[:, rows], lb), (ra[::-1, rows], rb[::-1])):
            alive, total = np.ones((x.shape[1], y.shape[1]), bool), np.zeros((x.shape[1], y.shape[1]), np.int32)
            for c in range(longer):
                alive &= x[c][:, None] == y[c][None, :]
                if not alive.any():
                    break
                total += alive
            common.append(total)
        most, least = np.maximum(sa[rows, None], sb[None, :]), np.minimum(sa[rows, None], sb[None, :])
        prefix, suffix = (np.minimum(c, least) for c in common)
        ok = (most == longer) & (prefix + suffix >= longer - 1) & (prefix < longer) & ((prefix >= longer // 2) == (side == 0))
        i, j = np.nonzero(ok)
        out.append((i + at, j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _best(names: list[str], n: np.ndarray, owner: np.ndarray, other: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
    """For each owner: its number of others, and the largest n among them with its word, the smallest of equals."""
    rank = np.empty(len(names), np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    order = np.lexsort((rank[other], -n[other], owner))
    owner, other = owner[order], other[order]
    heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else owner
    for at, size in zip(heads, np.diff(np.r_[heads, len(owner)]), strict=True):
        yield names[owner[at]], int(size), int(n[other[at]]), names[other[at]]


def _compared(batches: Iterator[pa.RecordBatch], pack: int) -> Iterator[pa.RecordBatch]:
    """Partial results of rows sorted by (longer, side, half, i, j): word, near, best_n, best."""

    def tile(key: tuple, rows: list[tuple[int, str, int]]) -> list:
        longer, side, i, j = key
        names, n = [r[1] for r in rows], np.array([r[2] for r in rows])
        if i == j:
            return list(_best(names, n, *near(names, None, longer, side)))
        mine = np.array([r[0] for r in rows]) == i
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        if not len(a) or not len(b):
            return []
        x, y = near([names[k] for k in a], [names[k] for k in b], longer, side)
        return list(_best(names, n, np.r_[a[x], b[y]], np.r_[b[y], a[x]]))

    def batch_of(found: list) -> pa.RecordBatch:
        kinds = (("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()))
        cols = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], [n for n, _ in kinds])

    key, half, rows, found = None, None, [], []
    for batch in batches:
        for longer, side, part, i, j, block, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            new = (longer, side, i, j)
            if rows and (new != key or ((part, i, j) != half and (i != 0 or j != 0 or len(rows) >= pack or len(rows) * longer >= CELLS))):
                found += tile(key, rows)
                rows = []
                if len(found) > 20_000:
                    yield batch_of(found)
                    found = []
            key, half = new, (part, i, j)
            rows.append((block, word, n))
    if rows:
        found += tile(key, rows)
    yield batch_of(found)


def near_words(found: DataFrame, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """(word, n_near, best) of the words (word, n) that differ by one code point from others; best: (minus its n, word)."""
    columns = ["longer", "side", "half", "i", "j", "block", "word", "n"]
    tiles = _tiled(_halves(found), block).select(*columns).repartition("longer", "side", "half", "i", "j").sortWithinPartitions("longer", "side", "half", "i", "j")
    parts = tiles.mapInArrow(lambda batches: _compared(batches, pack), "word string, near long, best_n long, best string")
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last form of each word's chain. Rounds double the steps that a row has taken."""
    now = table(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = table(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, ratio: int = 10, block: int = BLOCK, pack: int = PACK, noise: int = 31, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each word of docs: word, form, root, n, n_near, form_n.

    Words are those of words(). A word's form is the near word of largest n, the
    smallest in order of code points among equals, if it is ratio times as
    frequent; root follows forms to the last. Null and empty texts have no
    words, a null doc_id counts as empty in the hash, repeated rows count each,
    words of any length are compared whole, an empty table gives an empty
    result, and other columns take no part.
    """
    found = table(words(docs, noise=noise, text=text, doc_id=doc_id))
    met = table(near_words(found, block, pack))
    known = table(
        found.join(met, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.struct(F.col("best.w").alias("w"), (-F.col("best.m")).alias("n"))).alias("_form")
        )
    )
    ends = roots(known.where("_form IS NOT NULL").select("word", F.col("_form.w").alias("form")))
    return known.join(ends, "word", "left").select("word", F.col("_form.w").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("_form.n").alias("form_n"))
