"""Laplacian and Taubin smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.model import KEY
from tessera.sources.scratch import table


def _step(points: DataFrame, link: DataFrame, weight: float) -> DataFrame:
    to = points.select(KEY, F.col("vid").alias("neighbor"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"))
    mean = link.join(to, [KEY, "neighbor"]).groupBy(KEY, "vid").agg(*[F.avg(f"_{a}").alias(f"_{a}") for a in "xyz"])
    out = points.join(mean, [KEY, "vid"], "left")
    return out.withColumns({a: F.coalesce(F.col(a) + weight * (F.col(f"_{a}") - F.col(a)), F.col(a)) for a in "xyz"}).select(*points.columns)


def laplacian(points: DataFrame, link: DataFrame, rounds: int, weight: float = 0.5, every: int = 10) -> DataFrame:
    """points after rounds of moving each towards the mean of its neighbours; isolated points stay.

    link is written once, and the points every few rounds, so plans stay short.
    """
    link = table(link.select(KEY, "vid", "neighbor"))
    for k in range(rounds):
        points = _step(points, link, weight)
        if k % every == every - 1:
            points = table(points)
    return points


def taubin(points: DataFrame, link: DataFrame, rounds: int, weight: float = 0.5, pass_band: float = 0.1, every: int = 5) -> DataFrame:
    """Each round shrinks by weight and grows by 1 / (pass_band - 1 / weight)."""
    link = table(link.select(KEY, "vid", "neighbor"))
    for k in range(rounds):
        points = _step(_step(points, link, weight), link, 1 / (pass_band - 1 / weight))
        if k % every == every - 1:
            points = table(points)
    return points
