"""Queries of the operators on filters, conversations and search, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit
from .common import table
from .registry import query


@query(
    "op13_filter_audit",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
            regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), marks AS (
        SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
    ), m AS (
        SELECT part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
            + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
            + 8 * regexp_matches(t, '[#$%&*|]')::INT
            + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask,
            coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
        FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id
    ), cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    f AS (SELECT chr((65 + b)::INT) AS f, (1 << b)::INT AS bit FROM range(5) AS x(b)),
    orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f)
            JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
    ), steps AS (
        SELECT filter_order, s::INT AS step, bits[s] AS bit, list_sum(bits[1:s - 1]) AS before
        FROM orders, range(1, 6) AS x(s)
    ), counted AS (
        SELECT part, filter_order, step, bit,
            coalesce(sum(n) FILTER (mask & (coalesce(before, 0)::INT | bit) = 0), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & coalesce(before, 0)::INT > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
            coalesce(sum(toxic) FILTER (mask & coalesce(before, 0)::INT = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
        FROM cells, steps GROUP BY ALL
    )
    SELECT * EXCLUDE bit, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
    """,
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
