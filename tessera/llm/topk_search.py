"""Exact top-k inner products by columnar branch-and-bound.

Candidates stand in blocks by falling norm, laid out dimension by dimension.
Each query first meets the block of the largest norms, which gives its k-th best
score so far. A block is sent to a block of queries only if its largest norm can
still reach that for one of them. There, products are summed over a few
dimensions at a time; what the dimensions left can still add is bounded by the
norms of the two rests (Cauchy-Schwarz), and only candidates whose bound reaches
the best k known so far are kept for the next dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import table

STEP = 16
BLOCK = "block long, dim int, size double, least double, rids binary, ids binary, cols binary, floors binary"
#: Stands for a null vec_id, which comes last among ties.
LAST = (1 << 63) - 1
FOUND = "rid long, query_id long, vec_id long, score long"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (rid, vec_id, v, norm, floor) as blocks of at most size vectors of one length, each dimension's values together.

    size: the largest norm of a block; least: the smallest floor for a norm of 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rid, ids, norm, floor = (np.asarray(batch.column(c)) for c in (0, 1, 3, 4))
            flat, edge = np.asarray(batch.column(2).flatten()), np.asarray(batch.column(2).offsets)
            edge = edge - edge[0]
            length = np.diff(edge)
            for dim in np.unique(length).tolist():
                own = np.flatnonzero(length == dim)
                for at in range(0, len(own), size):
                    k = own[at : at + size]
                    cols = flat[edge[k][:, None] + np.arange(dim)].T if dim else np.zeros((0, len(k)), np.int64)
                    data = [np.ascontiguousarray(x, "<i8").tobytes() for x in (rid[k], ids[k], cols)]
                    least = float(np.min(np.where(norm[k] > 0, floor[k] / np.maximum(norm[k], 1e-300), -np.inf)))
                    types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
                    values = [number, dim, float(norm[k].max()), least, *data, floor[k].astype("<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])
                    number += 1

    return rows.select("rid", "vec_id", "v", "norm", "floor").mapInArrow(run, BLOCK)


def _reach(most: np.ndarray, floor: float) -> np.ndarray:
    """Which bounds reach a score, with room for the rounding of doubles."""
    return most + 1e-9 * np.abs(most) + 0.5 >= floor


def best(q: np.ndarray, own: int, x: np.ndarray, rests: list[np.ndarray], rids: np.ndarray, ids: np.ndarray, k: int, known: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best columns of x for q, but for the row numbered own.

    rests[j]: norms of the columns' dimensions from STEP * j on. known: a score
    that k other rows reach; what is below it may be left out.
    """
    live = np.flatnonzero(rids != own)
    live = live[_reach(np.sqrt(float((q.astype(float) ** 2).sum())) * rests[0][live], known)]
    if not len(live):
        return live, np.zeros(0, x.dtype)
    probe = live[: 8 * k]
    first = q @ x[:, probe]
    floor = max(known, np.partition(first, len(first) - k)[len(first) - k]) if len(first) >= k else known
    score = np.zeros(len(live), x.dtype)
    for j in range(len(rests) - 1):
        part = slice(STEP * j, STEP * (j + 1))
        score = score + q[part] @ (x[part] if len(live) == x.shape[1] else x[part][:, live])
        most = score + np.sqrt(float((q[STEP * (j + 1) :].astype(float) ** 2).sum())) * rests[j + 1][live]
        keep = _reach(most, floor)
        live, score = live[keep], score[keep]
    order = np.lexsort((ids[live], -score))[:k]
    return live[order], score[order]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0, block: int = 8192, query_block: int = 256) -> DataFrame:
    """The k rows with the highest integer inner products for each query row: query_id, rank, vec_id, score.

    Components count as floor(scale * x). Vectors that are null or hold a null
    or non-finite component take no part; only vectors of one length meet, so an
    empty vector meets empty ones with score 0. A query meets every row but its
    own, repeated rows of its vec_id included, and each of repeated query rows
    has its own k results. Ties go to the smaller vec_id, null last. Sums from
    2**52 on are summed as whole numbers; components or scores that don't fit a
    long are an error. An empty table gives no rows; other columns take no part.
    """
    x = F.col("_e")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    part = lambda c: F.when(F.abs(scale * c) < float(1 << 62), F.floor(scale * c).cast("long")).otherwise(F.raise_error(F.lit("a component doesn't fit a long")).cast("long"))
    rows = (
        vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), is_query.alias("_q"), F.col(embedding).cast("array<double>").alias("_e"))
        .where(x.isNotNull() & whole)
        .select("rid", F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "_q", F.transform(x, part).alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))
        .withColumn("floor", F.lit(float("-inf")))
    )
    rows = table(rows)
    candidates = table(_blocks(rows.drop("_q").repartitionByRange(F.desc("norm"), "rid").sortWithinPartitions(F.desc("norm"), "rid"), block))
    # The first block of each length has its largest norms.
    tops = table(candidates.groupBy("dim").agg(F.max(F.struct("size", (-F.col("block")).alias("b"))).alias("m")).select("dim", (-F.col("m.b")).alias("block")))
    of = lambda q: _blocks(q, query_block).select(*[F.col(c).alias(f"q_{c}") for c in ("block", "dim", "size", "least", "rids", "ids", "cols", "floors")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, rids, qids, qrids = (np.frombuffer(r[c], "<i8") for c in ("ids", "rids", "q_ids", "q_rids"))
                x = np.frombuffer(r["cols"], "<i8").reshape(r["dim"], len(ids))
                q, floors = np.frombuffer(r["q_cols"], "<i8").reshape(r["dim"], len(qids)).T, np.frombuffer(r["q_floors"], "<f8")
                top = [float(np.abs(a).max(initial=0)) for a in (x, q)]
                square = x.astype(float) ** 2
                if top[0] * top[1] * max(1, r["dim"]) < 2**52:  # then sums of doubles are exact
                    x, q = x.astype(float), np.ascontiguousarray(q, float)
                elif top[0] * top[1] * max(1, r["dim"]) >= 2**62:
                    x, q = x.astype(object), q.astype(object)
                rests = [np.sqrt(square[s:].sum(0)) for s in range(0, r["dim"] + STEP, STEP)]
                found = [best(q[i], qrids[i], x, rests, rids, ids, k, floors[i]) for i in range(len(qids))]
                n = [len(p) for p, _ in found]
                at = np.concatenate([p for p, _ in found])
                cols = [np.repeat(qrids, n), np.repeat(qids, n), ids[at], np.array([int(v) for _, s in found for v in s], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rid", "query_id", "vec_id", "score"])

    def met(pairs: DataFrame) -> DataFrame:
        return pairs.select("dim", "rids", "ids", "cols", "q_rids", "q_ids", "q_cols", "q_floors").mapInArrow(run, FOUND)

    queries = rows.where("_q").drop("_q")
    # One block of candidates for each length meets all queries of the length, which are dealt out.
    front = of(queries).repartition("q_block").join(F.broadcast(tops), F.col("q_dim") == F.col("dim")).drop("dim")
    first = table(met(front.join(candidates, "block")))
    floors = first.groupBy("rid").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") >= k).select("rid", F.col("s").cast("double").alias("floor"))
    queries = queries.drop("floor").join(floors, "rid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    ratio = F.col("floor") / F.greatest("norm", F.lit(1e-300))
    queries = table(of(queries.repartitionByRange(ratio, "rid").sortWithinPartitions(ratio, "rid")))
    # The other blocks go to the blocks of queries that they can still serve, each pair once.
    heads = candidates.select("block", "dim", "size").join(tops, ["block", "dim"], "left_anti")
    pairs = queries.select("q_block", "q_dim", "q_least", "q_size").join(heads, (F.col("q_dim") == F.col("dim")) & (F.col("size") * (1 + 1e-9) + F.when(F.col("q_size") > 0, F.lit(1.0)).otherwise(F.lit(0.0)) / F.greatest("q_size", F.lit(1e-300)) >= F.col("q_least")))
    pairs = table(pairs.select("q_block", "block"))
    rest = pairs.join(candidates, "block").join(queries, "q_block")
    w = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    none = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    found = first.unionByName(met(rest))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(none("query_id"), "rank", none("vec_id"), "score")
