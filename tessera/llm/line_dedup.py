"""Removal of lines that many sites share.

For each line's hash a HyperLogLog sketch of the sites that hold it is built in
every map task, and sketches merge by aggregation. Lines whose estimate is near
the threshold get an exact count of distinct sites; the others are decided by
the estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import table, text_or_empty


def _line_hash(line: Column) -> Column:
    """Of the line without spaces at its ends."""
    return F.xxhash64(F.trim(line))


def boilerplate(lines: DataFrame, min_sites: int, precision: int = 12, band: float = 0.1) -> DataFrame:
    """Hashes h of lines (h, site) on min_sites sites or more.

    band: estimates this near the threshold are counted exactly; the standard
    error of a sketch is 1.04 / sqrt(2 ** precision), 1.6 % for 12.
    """
    spread = table(lines.where(F.col("site").isNotNull()).groupBy("h").agg(F.hll_sketch_agg("site", precision).alias("s")).select("h", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= min_sites * (1 - band) - 1))
    near = F.col("n") <= min_sites * (1 + band) + 1
    sure = spread.where(~near).select("h")
    exact = lines.join(spread.where(near).select("h"), "h").groupBy("h").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return table(sure.unionByName(exact.select("h")))


def line_dedup(docs: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, clean_text, n_lines, n_removed.

    Lines end at newlines and are compared without spaces at their ends; blank
    lines are never removed. A line goes, wherever it stands, if rows of at
    least min_sites distinct sites hold it; a null site counts for none. Null
    texts count as empty. Repeated rows, and rows with a null doc_id, are
    treated each by its own text. Texts of any length count whole, an empty
    table gives an empty result, and other columns take no part.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), text_or_empty(F.col(text)).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t"))
    lines = rows.select("doc_id", "th", "site", F.explode(F.split("t", "\n", -1)).alias("line")).where(F.trim("line") != "")
    lines = lines.select("doc_id", "th", "site", _line_hash(F.col("line")).alias("h"))
    bad = boilerplate(lines.select("h", "site"), min_sites)
    # What goes depends on the text: rows with one doc_id, or none, have a set of hashes for each text.
    held = lines.join(bad, "h").groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("h").alias("bad"))
    both = rows.join(held, (rows["th"] == held["_th"]) & rows["doc_id"].eqNullSafe(held["_id"]), "left").drop("_id", "_th")
    parts = both.withColumn("l", F.split("t", "\n", -1))
    kept = F.filter("l", lambda x: (F.trim(x) == "") | ~F.array_contains("bad", _line_hash(x)))
    parts = parts.withColumn("k", F.when(F.col("bad").isNull(), F.col("l")).otherwise(kept))
    return parts.select(
        "doc_id",
        F.array_join("k", "\n").alias("clean_text"),
        F.size(F.filter("l", lambda x: F.trim(x) != "")).alias("n_lines"),
        (F.size("l") - F.size("k")).alias("n_removed"),
    )
