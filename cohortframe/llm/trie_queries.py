"""Query of the conversation prefix trie, and SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortframe.session import materialised

from . import prefix_trie
from .common import table
from .registry import query


@query(
    "op12_prefix_trie",
    """
    WITH RECURSIVE t AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), crc AS (
        SELECT DISTINCT c, c::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS x FROM t
        UNION ALL
        SELECT c, s, k + 1, xor(y >> 1, (y & 1) * 3988292384) FROM (
            SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(x, ascii(s[k // 8 + 1])::BIGINT) ELSE x END AS y FROM crc WHERE k < 8 * length(s)
        )
    ), convs AS (SELECT c, xor(x, 4294967295) % 6 AS h FROM crc WHERE k = 8 * length(s)),
    parts AS (
        SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN t ON t.c = convs.c - convs.c % 100 AND pos < h
        UNION ALL SELECT t.c, 1, pos, role, text FROM t JOIN convs ON t.c = convs.c AND pos >= h
    ), rebuilt AS (
        SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, length(text) AS points,
            sha256(length(role) || ':' || role || text) AS digest FROM parts
    ), m AS (
        SELECT c, 0 AS d, '' AS node, 0 AS points FROM convs
        UNION ALL SELECT c, d, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS node, points FROM rebuilt
    ), linked AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS above, d = max(d) OVER (PARTITION BY c) AS ends FROM m),
    n AS (
        SELECT d, node, min(c) AS conv_id, count(*) AS n, any_value(points) AS points, any_value(above) AS above,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM linked GROUP BY d, node
    ), children AS (SELECT d - 1 AS d, above AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN children USING (d, node)),
    below AS (
        SELECT m.d, m.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.points) AS saved
        FROM known u JOIN m ON m.c = u.conv_id AND m.d <= u.d GROUP BY ALL
    )
    SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, n_leaves, saved::BIGINT AS saved_tokens, k.ends_sha256
    FROM known k JOIN below USING (d, node) LEFT JOIN n p ON p.d = k.d - 1 AND p.node = k.above
    """,
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialised(prefix_trie.turns_of(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns), turns.select("conv").distinct())
