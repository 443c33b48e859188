"""Sharding by extendible hashing, DataFrame functions only.

A directory maps the leading bits of each key's hash to a shard. One aggregate
of bytes by prefix serves several bits at a time; a bucket over the limit splits
on its next bit, all others stay as they are, and only rows of buckets that are
still too large go to a further round with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import table, text_or_empty

HASH_BITS = 60


def hash60(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value as text; null counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _round(rows: DataFrame, base: int, bits: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves among the buckets of depth base to base + bits, and the cells that must split further.

    rows: root, key, bytes. Both results have root, cell (the first base + bits
    bits); leaves also depth, prefix, shard_bytes, shard_docs, lone.
    """
    deep = base + bits
    cells = rows.groupBy("root", F.shiftright("key", HASH_BITS - deep).alias("cell")).agg(
        F.sum("bytes").alias("b"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")
    )
    levels = F.array(*[F.struct(F.lit(base + j).alias("depth"), F.shiftright("cell", bits - j).alias("prefix")) for j in range(bits + 1)])
    buckets = (
        cells.select("root", F.explode(levels).alias("k"), "b", "n", "lo", "hi")
        .groupBy("root", F.col("k.depth").alias("depth"), F.col("k.prefix").alias("prefix"))
        .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), (F.min("lo") == F.max("hi")).alias("lone"))
        .withColumn("splits", (F.col("shard_bytes") > limit) & ~F.col("lone"))
    )
    buckets = table(buckets)
    above = buckets.select("root", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"), F.col("splits").alias("_open"))
    tree = buckets.withColumn("_up", F.shiftright("prefix", 1)).join(above, ["root", "depth", "_up"], "left")
    leaf = tree.where(~F.col("splits") & F.coalesce("_open", F.lit(True)))
    wide = F.expr(f"shiftleft(1L, {deep} - depth)")
    covered = F.sequence(F.col("prefix") * wide, F.col("prefix") * wide + wide - 1)
    leaves = leaf.select("root", "depth", "prefix", "shard_bytes", "shard_docs", "lone", F.explode(covered).alias("cell"))
    return leaves, buckets.where(F.col("splits") & (F.col("depth") == deep)).select("root", F.col("prefix").alias("cell"))


def _split(rows: DataFrame, limit: int, first_bits: int) -> DataFrame:
    """rows with depth, prefix, shard_bytes, shard_docs, lone."""
    done, base, bits = None, 0, first_bits
    while True:
        leaves, rest = _round(rows.select("root", "key", "bytes"), base, bits, limit)
        here = rows.withColumn("cell", F.shiftright("key", HASH_BITS - base - bits))
        placed = table(here.join(leaves, ["root", "cell"]).drop("cell"))
        done = placed if done is None else done.unionByName(placed)
        base += bits
        if base >= HASH_BITS or rest.isEmpty():
            return done
        rows, bits = table(here.join(rest, ["root", "cell"], "left_semi").drop("cell")), min(4, HASH_BITS - base)


def shard(docs: DataFrame, limit_bytes: int = 128 << 20, text: str = "text", doc_id: str = "doc_id", row: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, shard_id, shard_depth, shard_bytes, shard_docs.

    row names a column of distinct whole numbers, which the result then has too.
    A shard holds at most limit_bytes of UTF-8 text, unless one row alone is
    larger: that row is a shard of its own. The hash is that of doc_id, null as
    the empty text; where rows of one doc_id exceed the limit together, they
    split further by a hash of the row's number. Null and empty texts have no
    bytes; an empty table has no shards; other columns take no part.
    """
    rows = table(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("rid"),
            F.lit(0).cast("long").alias("root"),
            F.col(doc_id).alias("doc_id"),
            hash60(F.col(doc_id)).alias("key"),
            F.octet_length(text_or_empty(F.col(text))).cast("long").alias("bytes"),
        )
    )
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(24, max(1, math.ceil(math.log2(max(1, total / limit_bytes))) + 3))
    placed = _split(rows, limit_bytes, bits)
    hot = placed.where(F.col("lone") & (F.col("shard_docs") > 1) & (F.col("shard_bytes") > limit_bytes))
    name = F.concat_ws("-", "depth", "prefix")
    final = placed.withColumn("shard_id", name)
    if not hot.isEmpty():
        again = hot.select("rid", F.col("key").alias("root"), "doc_id", hash60(F.col("rid")).alias("key"), "bytes")
        again = _split(table(again), limit_bytes, 4).withColumn("shard_id", F.concat_ws("-", F.lit(HASH_BITS), "root", name))
        again = again.withColumn("depth", F.col("depth") + HASH_BITS)
        cold = ~F.col("lone") | (F.col("shard_docs") == 1) | (F.col("shard_bytes") <= limit_bytes)
        final = final.where(cold).unionByName(again)
    return final.select("doc_id", "shard_id", F.col("depth").alias("shard_depth"), "shard_bytes", "shard_docs", *([F.col("rid").alias(row)] if row else []))


def directory(placed: DataFrame) -> DataFrame:
    """The directory of shards: shard_id, shard_depth, prefix, shard_bytes, shard_docs.

    prefix has the leading bits of the hash as text; of a doc_id that was split
    by rows, the doc_id's bits come before those of the row. An empty table has
    an empty directory.
    """
    bits = lambda n, width: F.lpad(F.conv(n, 10, 2), width, "0")
    part = F.split("shard_id", "-")
    lone = F.size(part) == 4
    width = F.when(lone, part[2]).otherwise(part[0]).cast("int")
    own = F.when(width > 0, F.lpad(F.conv(F.when(lone, part[3]).otherwise(part[1]), 10, 2), width, F.lit("0"))).otherwise("")
    prefix = F.when(lone, F.concat(bits(part[1], HASH_BITS), own)).otherwise(own)
    return placed.select("shard_id", "shard_depth", "shard_bytes", "shard_docs").distinct().withColumn("prefix", prefix)


def write_shards(docs: DataFrame, path: str, limit_bytes: int = 128 << 20, text: str = "text", doc_id: str = "doc_id") -> None:
    """Write docs as one folder and file for each shard (shard_id=...), and the directory as _directory beside them.

    Rows go where shard() puts them, repeated rows and null doc_ids too; a task
    writes its shards one after the other. docs must not have a column shard_id;
    an empty table writes no shard.
    """
    if "shard_id" in docs.columns:
        raise ValueError("docs already has a column shard_id")
    row = next(c for c in (f"_row{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = table(shard(numbered, limit_bytes, text, doc_id, row))
    numbered.join(placed.select(row, "shard_id"), row).drop(row).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
    directory(placed).write.parquet(f"{path}/_directory")
