"""Exact deduplication by deterministic block naming, DataFrame functions only.

Every normalised text is cut into blocks of a fixed number of characters. Equal
blocks get one integer name and different blocks different names; then adjacent
names are paired and the pairs named in the same way, again and again, until one
integer is left for each text. No name depends on a hash being unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import table, text_or_empty

BUCKETS = 1 << 14


def _ranked(keys: DataFrame, bucket: Column, *order: str) -> DataFrame:
    """A name for each row: its rank in the sorted bucket, below the bucket's number."""
    w = Window.partitionBy("_bucket").orderBy(*order)
    return (
        keys.withColumn("_bucket", F.pmod(bucket, F.lit(BUCKETS)).cast("long"))
        .withColumn("_name", F.shiftleft("_bucket", 40) + F.row_number().over(w))
        .drop("_bucket")
    )


def name_blocks(blocks: DataFrame, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """(_f, _variant, _name) for the column _block.

    Blocks meet by fingerprint, each distinct block once per map task. A
    fingerprint with one distinct block needs no text any more (_variant is
    null); where different blocks share a fingerprint each keeps its text in
    _variant and gets a name of its own.
    """
    met = blocks.groupBy(fingerprint(F.col("_block")).alias("_f")).agg(F.sort_array(F.collect_set("_block")).alias("_all"))
    one = F.array(F.lit(None).cast("string"))
    flat = met.select("_f", F.explode(F.when(F.size("_all") > 1, F.col("_all")).otherwise(one)).alias("_variant"))
    return _ranked(flat, F.col("_f"), "_f", "_variant")


def _halve(docs: DataFrame) -> DataFrame:
    """One round: the names of each text in pairs, each pair named."""
    pairs = docs.select(
        "_rid",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.ceil(F.size("_names") / 2).cast("int") - 1),
                lambda i: F.struct(
                    F.element_at("_names", 2 * i + 1).alias("a"),
                    F.coalesce(F.get("_names", 2 * i + 1), F.lit(-1)).alias("b"),
                ),
            )
        ).alias("_i", "_p"),
    ).select("_rid", "_i", F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"))
    named = _ranked(pairs.select("_a", "_b").distinct(), F.xxhash64("_a", "_b"), "_a", "_b")
    back = pairs.join(named, ["_a", "_b"]).groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("_i", "_name"))).alias("_l"))
    return back.select("_rid", F.col("_l._name").alias("_names"))


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    block_chars: int = 4096,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
    row: str | None = None,
) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    row names a column of distinct whole numbers, which the result then has too.

    Texts are equal when they are identical after each run of ASCII white space
    became one space. Null and empty texts are equal to each other. Of equal
    texts the row with the smallest doc_id stays, a null doc_id coming after all
    others; of repeated rows with one doc_id exactly one stays. An empty table
    gives an empty result; other columns take no part, whatever their names.
    """
    norm = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("_rid"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.regexp_replace(text_or_empty(F.col(text)), r"[\x20\x09-\x0D]+", " ").alias("_t"),
    )
    cut = F.when(F.col("_t") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("_t", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )
    names = table(name_blocks(norm.select(F.explode(cut).alias("_block")), fingerprint))
    parts = norm.select("_rid", "doc_id", F.sha2("_t", 256).alias("_sha"), cut.alias("_blocks"))
    parts = parts.select("_rid", "doc_id", "_sha", F.size("_blocks").alias("_n"), F.posexplode("_blocks").alias("_i", "_block"))
    parts = parts.withColumn("_f", fingerprint(F.col("_block"))).withColumn("_sha", F.when(F.col("_i") == 0, F.col("_sha")))
    if names.where(F.col("_variant").isNotNull()).isEmpty():
        named = parts.drop("_block").join(names.drop("_variant"), "_f")
    else:  # some fingerprint has two texts: compare these texts themselves
        same = (parts["_f"] == names["_f"]) & F.coalesce(names["_variant"] == parts["_block"], F.lit(True))
        named = parts.join(names, same).drop("_block", "_variant")
    named = table(named.select("_rid", "doc_id", "_sha", "_n", "_i", "_name"))

    single = named.where("_n = 1").select("_rid", F.lit(0).alias("_level"), "_name")
    done = [single]
    level, most = 0, named.agg(F.max("_n")).first()[0] or 0
    left = (
        named.where("_n > 1")
        .groupBy("_rid")
        .agg(F.sort_array(F.collect_list(F.struct("_i", "_name"))).alias("_l"))
        .select("_rid", F.col("_l._name").alias("_names"))
    )
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        left = table(_halve(left))
        done.append(left.where(F.size("_names") == 1).select("_rid", F.lit(level).alias("_level"), F.get("_names", F.lit(0)).alias("_name")))
        left = left.where(F.size("_names") > 1)
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    heads = named.where("_i = 0").select("_rid", "doc_id", "_sha")
    rows = table(heads.join(identity, "_rid"))
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_rid").alias("r"))
    groups = table(rows.groupBy("_level", "_name").agg(F.min(first).alias("_k"), F.count("*").alias("group_size")))
    return rows.join(groups, ["_level", "_name"]).select(
        "doc_id",
        F.col("_k.d").alias("keep_id"),
        "group_size",
        (F.col("_rid") == F.col("_k.r")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_rid").alias(row)] if row else []),
    )
