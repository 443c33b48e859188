"""Upkeep of a stored spatial index from a stream of changed boxes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.model import KEY
from tessera.operators.spatial import index_cells
from tessera.sources.scratch import table


def index_updater(load: Callable[[], DataFrame], store: Callable[[DataFrame], None], size: float) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: boxes (mesh_id, id, low, high, removed, seq) replace those of their id in the index.

    Of several changes to one id in a batch the one with the largest seq holds.
    A batch that runs again after a failure leaves the same index.
    """

    def apply(batch: DataFrame, _: int) -> None:
        w = Window.partitionBy(KEY, "id").orderBy(F.desc("seq"))
        last = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        index = load()
        clean = index.join(last.select(KEY, "id"), [KEY, "id"], "left_anti")
        new = index_cells(last.where("NOT removed").select(KEY, "id", "low", "high"), size)
        store(table(clean.unionByName(new.select(*index.columns))))

    return apply


def _part(size: float, coarse: float, parts: int) -> Column:
    """The partition of a row of the index: by mesh and by the coarse cell that holds its cell."""
    cells = [F.floor(F.col(f"c{a}") * size / coarse) for a in "xyz"]
    return F.pmod(F.xxhash64(KEY, *cells), F.lit(parts)).cast("int")


def write_index(boxes: DataFrame, path: str, size: float, coarse: float, parts: int = 256) -> None:
    """Store the index of boxes (mesh_id, id, low, high), what lies together in one partition."""
    index_cells(boxes, size).withColumn("part", _part(size, coarse, parts)).repartition("part").write.partitionBy("part").parquet(path)


def partition_updater(spark: SparkSession, path: str, size: float, coarse: float, parts: int = 256) -> Callable[[DataFrame, int], None]:
    """As index_updater, for an index that write_index stored with the same measures: a batch rewrites the partitions it touches only.

    These are the ones that hold a changed id, found by reading ids alone, and
    those that changed boxes enter; there are at most parts of them. A batch that
    runs again, even after it was written in part, leaves the same index.
    """

    def apply(batch: DataFrame, _: int) -> None:
        w = Window.partitionBy(KEY, "id").orderBy(F.desc("seq"))
        last = table(batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r"))
        new = table(index_cells(last.where("NOT removed").select(KEY, "id", "low", "high"), size).withColumn("part", _part(size, coarse, parts)))
        index = spark.read.schema(new.schema).parquet(path)
        changed = last.select(KEY, "id")
        touched = index.select(KEY, "id", "part").join(changed, [KEY, "id"], "left_semi").select("part").unionByName(new.select("part")).distinct()
        touched = sorted(r[0] for r in touched.collect())  # at most parts
        if not touched:
            return
        kept = index.where(F.col("part").isin(touched)).join(changed, [KEY, "id"], "left_anti")
        merged = table(kept.select(*new.columns).unionByName(new))
        empty = sorted(set(touched) - {r[0] for r in merged.select("part").distinct().collect()})
        merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        if empty:  # a partition that loses all its rows gets a file without any
            blank = merged.limit(0).drop("part")
            for part in empty:
                blank.write.mode("overwrite").parquet(f"{path}/part={part}")

    return apply
