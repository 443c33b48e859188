"""Registered queries of the vector search, sharding and line operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import line_dedup
from .sharding import shard
from .topk_search import top_k

#: Small, so that the test tables make more than one shard.
SHARD_BYTES = 1 << 20
MIN_SITES = 10


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.length("clean_text").alias("clean_chars"), F.md5(F.col("clean_text").cast("binary")).alias("clean_md5"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


QUERIES = {"op1_line_dedup": op1_line_dedup, "op3_sharding": op3_sharding, "op5_topk_search": op5_topk_search}

ORACLES = {
    "op1_line_dedup": f"""
        WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        bad AS (
            SELECT x FROM (SELECT source, trim(unnest(l), ' ') AS x FROM d) WHERE x <> ''
            GROUP BY x HAVING count(DISTINCT source) >= {MIN_SITES}
        ), n AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM d),
        k AS (SELECT n.doc_id, n.i, n.raw, trim(n.raw, ' ') <> '' AS full_line, bad.x IS NOT NULL AS gone FROM n LEFT JOIN bad ON trim(n.raw, ' ') = bad.x),
        t AS (
            SELECT doc_id, count(*) FILTER (full_line) AS n_lines, count(*) FILTER (gone) AS n_removed,
                   coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '') AS c
            FROM k GROUP BY doc_id
        ) SELECT doc_id, n_lines, n_removed, length(c) AS clean_chars, md5(c) AS clean_md5 FROM t
    """,
    "op3_sharding": f"""
        WITH h AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS b,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents
        ), s AS (
            SELECT d, k >> (60 - d)::INT AS p, sum(b) AS shard_bytes, count(*) AS shard_docs, min(k) = max(k) AS lone
            FROM h, range(61) AS r(d) GROUP BY 1, 2
        ), leaf AS (
            SELECT h.doc_id, min(s.d) AS d FROM h, range(61) AS r(d), s
            WHERE s.d = r.d AND s.p = h.k >> (60 - r.d)::INT AND (s.shard_bytes <= {SHARD_BYTES} OR s.lone) GROUP BY h.doc_id
        )
        SELECT h.doc_id, s.d || '-' || s.p AS shard_id, s.d AS shard_depth, s.shard_bytes::BIGINT AS shard_bytes, s.shard_docs
        FROM h JOIN leaf USING (doc_id) JOIN s ON s.d = leaf.d AND s.p = h.k >> (60 - leaf.d)::INT
    """,
    "op5_topk_search": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
