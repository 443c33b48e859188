"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only.

Each source has a target number of words. Its documents, shuffled by a hash,
get a virtual finish time: the words of the source up to and with the document,
divided by the target; a second pass over the source goes on counting. All
passes sorted by finish time across tasks are the mix, which ends where the
total budget is used up.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import table, text_or_empty
from ._order import running
from .sharding import hash60

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(rows: DataFrame, weights: Sequence[int] | DataFrame, share: Fraction, passes: int) -> DataFrame:
    """(source, rank, weight, source_size, target) of rows (source, size).

    rank counts sources by code point from 0 on, null last. Targets are in
    proportion to the weights and sum up to share times all sizes, but stop at
    passes times the source's size; what is left over is dealt out among the
    others by weight until no target is above. A round takes one sum over the
    sources, and only sources that newly stop call for another.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(sizes.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], rank=F.lit(1))
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        ranked = ranked.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = table(ranked.select("source", "rank", "weight", "source_size", (F.col("source_size") * passes).alias("_most")))
    budget = float(share * (ranked.agg(F.sum("source_size")).first()[0] or 0))
    level, stopped = 0.0, -1
    while True:
        full = F.col("_most") <= F.lit(level) * F.col("weight")
        n, words, left = ranked.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == stopped or left == 0:
            break
        stopped, level = n, (budget - words) / left
    if left == 0:
        level = float("inf")
    target = F.when(F.col("weight") == 0, 0.0).otherwise(F.least(F.lit(level) * F.col("weight"), F.col("_most").cast("double")))
    return ranked.select("source", "rank", "weight", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] | DataFrame,
    share: Fraction = Fraction(3, 2),
    passes: int = 2,
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    row: str | None = None,
) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, copies, finish.

    size counts words between ASCII white space; taken is size times copies, the
    number of times the mix takes the document whole (0 to passes). finish is the virtual
    time of its first pass. weights: numbers that repeat over the sources in
    order of code point, null last, or a table (source, weight); sources without
    a weight are not taken. share: words of the mix, as a part of all words.
    row names a column of distinct whole numbers, which the result then has too.

    Documents are shuffled by a hash of doc_id, so reruns agree; documents of
    one hash follow each other by doc_id (null first) and size, and repeated
    rows, alike in both, are interchangeable. Null and empty texts have no words
    and take nothing, a null source is a source, and an empty table gives an
    empty result. A source holds its target up to one of its documents. Other
    columns take no part.
    """
    rows = table(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("rid"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            hash60(F.col(doc_id)).alias("key"),
            F.regexp_count(text_or_empty(F.col(text)), F.lit(WORD)).cast("long").alias("size"),
        )
    )
    targets = table(source_targets(rows, weights, share, passes))
    budget = float(share * (targets.agg(F.sum("source_size")).first()[0] or 0))
    known = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("source", "_source")
    order = ("key", "doc_id", "size", "rid")
    queued = table(running(placed, ["rank"], order, done=F.col("size")))
    finish = lambda n: F.when(F.col("target") > 0, F.try_divide(n * F.col("source_size") + F.col("done"), F.col("target"))).otherwise(F.lit(float("inf")))
    place = lambda n: F.struct(finish(n).alias("finish"), F.col("rank"), n.alias("turn"), *[F.col(c) for c in order])
    turns = queued.where("size > 0 AND target > 0").select(F.explode(F.array(*[place(F.lit(i)) for i in range(passes)])).alias("at")).select("at.*")
    columns = ("finish", "rank", "turn", *order)
    total = running(turns, [], columns, total=F.col("size"))
    last = total.where(F.col("total") <= budget).agg(F.max(F.struct(*columns)).alias("at")).first()["at"]
    if last is None:
        copies = F.lit(0)
    else:
        end = F.struct(*[F.lit(last[c]).cast(total.schema[c].dataType).alias(c) for c in columns])
        copies = sum((F.when(place(F.lit(i)) <= end, 1).otherwise(0) for i in range(1, passes)), F.when(place(F.lit(0)) <= end, 1).otherwise(0))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    return queued.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
        finish(F.lit(0)).alias("finish"),
        *([F.col("rid").alias(row)] if row else []),
    )


def mixture(docs: DataFrame, weights: Sequence[int] | DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, in order of virtual finish time.

    Later passes over a source follow its first one. docs keeps its columns.
    """
    new = [n for n in (f"_row{i}" for i in range(len(docs.columns) + 4)) if n not in docs.columns][:4]
    row, copies, at, turn = new
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(numbered, weights, row=row, **how).where("copies > 0")
    step = F.try_divide("source_size", "target")
    taken = taken.select(row, "finish", step.alias(copies), F.posexplode(F.sequence(F.lit(1), "copies")).alias(turn, at))
    taken = taken.select(row, (F.col("finish") + F.col(turn) * F.col(copies)).alias(at), turn)
    return numbered.join(taken, row).orderBy(at, row, turn).select(*[F.col(f"`{c}`") for c in docs.columns])
