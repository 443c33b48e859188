"""Running sums over sorted rows, across tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import table


def running(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """rows with a running sum, this row included, of each whole-number column in sums, by group and in order.

    Rows are sorted across tasks by (group, order), so that a group of any size
    is cut into stretches; each stretch is summed by itself and adds the totals
    of the stretches before it, one row for each task and group. Group columns
    must not be null; without any the whole table is one group.
    """
    at = table(rows.orderBy(*group, *order).withColumn("_k", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_k", 33)))
    here = Window.partitionBy(*group, "_part").orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy(*group, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select(*group, "_part", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums])
    found = at.withColumns({n: F.sum(c).over(here) for n, c in sums.items()}).join(before, [*group, "_part"])
    return found.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_k", "_part", *[f"_before_{n}" for n in sums])
