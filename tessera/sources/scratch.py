"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset in
    local mode (tests), a temporary folder is made once and set; a cluster
    without it is an error, as executors don't share such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: lost executors cost only the tasks that ran on them,
    and a result with several readers is computed once. Joins of the result are
    sort-merge joins (see merging).
    """
    return merging(written(df))


def merging(df: DataFrame) -> DataFrame:
    """df, of which joins are sort-merge joins unless the other side asks for a broadcast.

    Spark decides on broadcasts by the size of files, and columns of small whole
    numbers take a hundredth of their rows' memory there: without this, tables of
    millions of rows pass through the driver whole.
    """
    return df.hint("merge")


def onto_points(rows: DataFrame, points: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with their points, which are fewer: each task keeps its points in a hash table, and rows are not sorted.

    Hints go with a table through anything but a join or a union, and a merge
    hint on either side would win; so rows pass through a union with no rows.
    """
    return rows.unionByName(rows.limit(0)).join(points.hint("shuffle_hash"), on)


def written(df: DataFrame) -> DataFrame:
    """Like table, with joins as Spark chooses them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
