"""Registered queries of the deduplication operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .substring_dedup import passages


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", "rep_id", "n_links", "n_shingles")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "salt")


QUERIES = {"op2_substring_dedup": op2_substring_dedup, "op4_jaccard_join": op4_jaccard_join, "op6_exact_dedup": op6_exact_dedup}

ORACLES = {
    "op4_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS l FROM documents
        ), s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
                   ELSE [array_to_string(l[i:i + 4], ' ') FOR i IN range(1, len(l) - 3)] END)) AS g FROM w
        ), c AS (SELECT g, min(doc_id) AS rep_id, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
        x AS (SELECT rep_id, n, unnest(g) AS sh FROM c),
        p AS (
            SELECT a.rep_id AS a, b.rep_id AS b FROM x AS a JOIN x AS b ON a.sh = b.sh AND a.rep_id <> b.rep_id
            GROUP BY a.rep_id, b.rep_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
        ), r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        k AS (SELECT a, least(a, min(b)) AS class_id FROM r GROUP BY a),
        d AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
        SELECT s.doc_id, coalesce(k.class_id, c.rep_id, s.doc_id) AS class_id, coalesce(c.rep_id, s.doc_id) AS rep_id,
               coalesce(d.n_links, 0) AS n_links, len(s.g)::INT AS n_shingles
        FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN k ON k.a = c.rep_id LEFT JOIN d ON d.a = c.rep_id
    """,
    "op6_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        ), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
}
