"""Registered queries of the operators on words, conversations and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import rebuilt_trie
from .mixing import mix
from .spelling_variants import spelling_variants

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), WEIGHTS).drop("copies", "finish")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_conversation_trie": op12_conversation_trie, "op13_source_mixing": op13_source_mixing}

#: CRC-32 of a list of bytes in a column b, by its table of 256 entries in t.e.
CRC_TABLE = """
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS e
    FROM (SELECT unnest(range(256)) AS i)
"""
CRC = "xor(list_reduce(b, lambda c, x: xor(c >> 8, e[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"

ORACLES = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE t AS ({CRC_TABLE}),
        r AS (
            SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
            FROM documents
        ), c AS (
            SELECT r, flatten([CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END FOR x IN string_split(d || ':' || r, '')]) AS b FROM r WHERE length(r) >= 7
        ), h AS (SELECT r, {CRC} AS h FROM c, t),
        w AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word FROM h
        ), n AS (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
        k AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM n, range(1, 28) AS x(i) WHERE i <= length(word)),
        p AS (
            SELECT x.word, y.word AS other FROM k AS x JOIN k AS y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT k.word, n.word FROM k JOIN n ON n.word = k.a || k.b
            UNION SELECT n.word, k.word FROM k JOIN n ON n.word = k.a || k.b
        ), f AS (
            SELECT p.word, count(*) AS n_near, max(n.n) AS best_n, arg_min(p.other, (-n.n, p.other)) AS best FROM p JOIN n ON n.word = p.other GROUP BY p.word
        ), g AS (
            SELECT n.word, n.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n.n THEN best END AS form, CASE WHEN best_n >= 10 * n.n THEN best_n END AS form_n
            FROM n LEFT JOIN f ON f.word = n.word
        ), s(word, root) AS (SELECT word, word FROM g UNION SELECT s.word, g.form FROM s JOIN g ON g.word = s.root WHERE g.form IS NOT NULL)
        SELECT g.word, g.form, s.root, g.n, g.n_near, g.form_n FROM g JOIN s ON s.word = g.word JOIN g AS e ON e.word = s.root AND e.form IS NULL
    """,
    "op12_conversation_trie": f"""
        WITH t AS ({CRC_TABLE}),
        n AS (
            SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, turn
            FROM conversations WHERE conv_id IS NOT NULL
        ), o AS (SELECT conv_id, bytes, g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS p FROM n),
        c AS (SELECT conv_id, [ord(x) FOR x IN string_split(conv_id::VARCHAR, '')] AS b FROM (SELECT DISTINCT conv_id FROM n)),
        h AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC} % 9 AS h FROM c, t),
        r AS (
            SELECT h.conv_id, 0 AS tag, o.p, o.g, o.bytes FROM h JOIN o ON o.conv_id = h.base AND o.p <= h.h
            UNION ALL SELECT h.conv_id, 1, o.p, o.g, o.bytes FROM h JOIN o ON o.conv_id = h.conv_id AND o.p > h.h
        ), q AS (
            SELECT conv_id, bytes, row_number() OVER w AS depth, md5(string_agg(g, ',') OVER w) AS path FROM r
            WINDOW w AS (PARTITION BY conv_id ORDER BY tag, p ROWS UNBOUNDED PRECEDING)
            UNION ALL SELECT conv_id, 0, 0, '' FROM h
        ), z AS (SELECT conv_id, max(depth) AS last FROM q GROUP BY conv_id),
        v AS (
            SELECT path, depth, any_value(bytes) AS bytes, min(q.conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(q.conv_id::VARCHAR, ',' ORDER BY q.conv_id) FILTER (last = depth), '')) AS ends_sha256
            FROM q JOIN z ON q.conv_id = z.conv_id GROUP BY path, depth
        ), u AS (
            SELECT v.*, a.path AS up FROM v LEFT JOIN q AS a ON a.conv_id = v.conv_id AND a.depth = v.depth - 1
        ), k AS (SELECT up, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY up),
        f AS (SELECT u.*, coalesce(k.n_children, 0) AS n_children FROM u LEFT JOIN k ON k.up = u.path),
        s AS (
            SELECT a.path, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved_tokens
            FROM f JOIN q AS a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.path
        )
        SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
        FROM f JOIN s ON s.path = f.path LEFT JOIN v AS p ON p.path = f.up
    """,
    "op13_source_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
        ), w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][r % 3 + 1] AS weight, 2 * source_size AS most FROM s),
        b AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget FROM s),
        lv(i, level) AS (
            SELECT 0, 0::DOUBLE UNION ALL
            SELECT i + 1, (any_value(budget) - coalesce(sum(most) FILTER (most <= level * weight), 0)) / sum(weight) FILTER (most > level * weight)
            FROM lv, w, b WHERE i < 40 GROUP BY i
        ), t AS (SELECT w.*, least((SELECT max(level) FROM lv) * weight, most::DOUBLE) AS target FROM w),
        q AS (
            SELECT d.*, t.r, t.source_size, t.target,
                   sum(d.size) OVER (PARTITION BY t.r ORDER BY k, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS done
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), p AS (
            SELECT rid, size, sum(size) OVER (
                ORDER BY (turn * source_size + done)::DOUBLE / target, r, turn, k, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS total
            FROM q, (VALUES (0), (1)) AS x(turn) WHERE size > 0
        ), c AS (SELECT rid, sum(size)::BIGINT AS taken FROM p WHERE total <= (SELECT budget FROM b) GROUP BY rid)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN c USING (rid)
    """,
}
