"""Domain operators on the driver tables.

Order lines stand in for expression values: the customer or order is the cell, the part name
the gene, the nation the sample.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortframe.operators import donors, embed, enrich, glm, graph, markers, multiple, neighbours, pseudobulk, score, tidy, trend
from cohortframe.session import materialised

from .registry import Tables, query, r

# --- stand-ins --------------------------------------------------------------------------


def customer_expr(t: Tables):
    """(customer, part name) -> summed quantity: one row per cell and gene."""
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("o_custkey").alias("cell_id"), F.col("p_name").alias("gene"))
        .agg(F.sum("l_quantity").alias("logcount"))
    )


CUSTOMER_EXPR = """SELECT o_custkey AS cell_id, p_name AS gene, sum(l_quantity) AS logcount FROM lineitem
                   JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def colour_signatures(t: Tables):
    """Part names grouped by their first word."""
    return t.part.select(F.substring_index("p_name", " ", 1).alias("signature"), F.col("p_name").alias("gene")).distinct()


COLOUR_SIGNATURES = "SELECT DISTINCT split_part(p_name, ' ', 1) AS signature, p_name AS gene FROM part"


def customer_cells(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("nation")
    )


# --- p-values ---------------------------------------------------------------------------

_P_TABLE = """SELECT o_orderpriority AS family, o_orderkey AS test,
                     CASE WHEN o_orderstatus <> 'P' OR o_totalprice > 400000
                          THEN round(pow(o_totalprice / 600000, 3), 4) END AS p FROM orders"""


def _p_table(t: Tables):
    kept = (F.col("o_orderstatus") != "P") | (F.col("o_totalprice") > 400000)
    return t.orders.select(
        F.col("o_orderpriority").alias("family"),
        F.col("o_orderkey").alias("test"),
        F.when(kept, F.round(F.pow(F.col("o_totalprice") / 600000, 3), 4)).alias("p"),
    )


@query(
    "W5_holm",
    f"""WITH t AS ({_P_TABLE}), k AS (SELECT *, count(p) OVER (PARTITION BY family) AS n,
               row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, test) AS i FROM t)
        SELECT family, test, CASE WHEN p IS NOT NULL THEN round(least(1.0, max((n - i + 1) * p)
               OVER (PARTITION BY family ORDER BY p NULLS LAST, test ROWS UNBOUNDED PRECEDING)), 9) END AS adj_p_value,
               'holm' AS method FROM k""",
)
def _(t: Tables):
    adjusted = multiple.adjust_p(_p_table(t), "p", ["family"], "holm")
    return adjusted.select("family", "test", r("adj_p_value", 9).alias("adj_p_value"), "method")


@query(
    "W5_benjamini_hochberg",
    f"""WITH t AS ({_P_TABLE}), k AS (SELECT *, count(p) OVER (PARTITION BY family) AS n,
               row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, test) AS i FROM t)
        SELECT family, test, CASE WHEN p IS NOT NULL THEN round(least(1.0, min(n * p / i)
               OVER (PARTITION BY family ORDER BY p DESC NULLS FIRST, test DESC ROWS UNBOUNDED PRECEDING)), 9) END
               AS adj_p_value, 'BH' AS method FROM k""",
)
def _(t: Tables):
    adjusted = multiple.adjust_p(_p_table(t), "p", ["family"], "BH")
    return adjusted.select("family", "test", r("adj_p_value", 9).alias("adj_p_value"), "method")


# --- signature scores -------------------------------------------------------------------


@query(
    "D9_signature_mean_sum",
    f"""WITH e AS ({CUSTOMER_EXPR}), s AS ({COLOUR_SIGNATURES}),
             n AS (SELECT signature, count(*) AS n FROM s GROUP BY ALL),
             v AS (SELECT cell_id, signature, sum(logcount) AS v FROM e JOIN s USING (gene) GROUP BY ALL)
        SELECT c_custkey AS cell_id, n.signature, coalesce(v, 0) AS signature_sum,
               round(coalesce(v, 0) / n, 9) AS signature_mean
        FROM customer CROSS JOIN n LEFT JOIN v ON v.cell_id = c_custkey AND v.signature = n.signature""",
)
def _(t: Tables):
    cells = t.customer.select(F.col("c_custkey").alias("cell_id"))
    scored = score.signature_summary(cells, customer_expr(t), colour_signatures(t))
    return scored.withColumn("signature_mean", r("signature_mean", 9))


_RANK_SCORE = f"""
    WITH e AS ({CUSTOMER_EXPR}), s AS ({COLOUR_SIGNATURES}),
         n AS (SELECT signature, count(*) AS n FROM s GROUP BY ALL),
         z AS (SELECT c_custkey AS cell_id, count(e.gene) AS nnz FROM customer LEFT JOIN e ON e.cell_id = c_custkey GROUP BY ALL),
         r AS (SELECT cell_id, gene, rank() OVER (PARTITION BY cell_id ORDER BY logcount DESC)
                      + (count(*) OVER (PARTITION BY cell_id, logcount) - 1) / 2.0 AS rk FROM e),
         a AS (SELECT z.cell_id, s.signature, coalesce(rk, nnz + (64 - nnz + 1) / 2.0) AS rk
               FROM z CROSS JOIN s LEFT JOIN r ON r.cell_id = z.cell_id AND r.gene = s.gene),
         g AS (SELECT cell_id, signature, count(*) AS n, sum(CASE WHEN rk > 20 THEN 21.0 ELSE rk END) AS rs,
                      count(*) FILTER (WHERE rk <= 20) AS inside FROM a GROUP BY ALL)
    SELECT cell_id, signature, round(CASE WHEN inside = 0 THEN 0 ELSE
           greatest(0, 1 - (rs - n * (n + 1) / 2.0) / ({{largest}})) END, 9) AS score FROM g"""


def _rank_scores(t: Tables, normaliser: str = "trimmed"):
    cells = t.customer.select(F.col("c_custkey").alias("cell_id"))
    return score.rank_score(
        cells, customer_expr(t), colour_signatures(t), 64, max_rank=20, normaliser=normaliser
    )


@query("S12_rank_score", _RANK_SCORE.format(largest="n * 20 - n * (n + 1) / 2.0"))
def _(t: Tables):
    return _rank_scores(t).withColumn("score", r("score", 9))


@query("S12_rank_score_plain", _RANK_SCORE.format(largest="n * 20.0"))
def _(t: Tables):
    return _rank_scores(t, "plain").withColumn("score", r("score", 9))


# --- marker tests -----------------------------------------------------------------------

_MOMENTS = f"""e AS ({CUSTOMER_EXPR}),
    z AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL),
    d AS (SELECT gene, label, sum(logcount) AS s, sum(logcount * logcount) AS q FROM e
          JOIN customer ON c_custkey = cell_id JOIN z ON label = c_mktsegment GROUP BY ALL),
    m AS (SELECT gs.gene, z.label, n, coalesce(s, 0) / n AS mean,
                 (coalesce(q, 0) - coalesce(s, 0) * coalesce(s, 0) / n) / (n - 1) AS variance
          FROM (SELECT DISTINCT gene FROM e) gs CROSS JOIN z LEFT JOIN d ON d.gene = gs.gene AND d.label = z.label)"""


@query(
    "S1_marker_welch_t",
    f"""WITH {_MOMENTS}
        SELECT a.gene, a.label, b.label AS other, a.n, b.n AS n_other, round(a.mean - b.mean, 6) AS log_fc,
               round((a.mean - b.mean) / sqrt(a.variance / a.n + b.variance / b.n), 6) AS t,
               round(pow(a.variance / a.n + b.variance / b.n, 2) / (pow(a.variance / a.n, 2) / (a.n - 1)
                     + pow(b.variance / b.n, 2) / (b.n - 1)), 4) AS df
        FROM m a JOIN m b ON a.gene = b.gene AND a.label <> b.label""",
)
def _(t: Tables):
    tested = markers.marker_ttest(customer_expr(t), customer_cells(t), "label", with_p=False)
    return tested.withColumns({"log_fc": r("log_fc"), "t": r("t"), "df": r("df", 4)})


@query(
    "S1_marker_welch_p",
    f"""WITH {_MOMENTS},
        w AS (SELECT a.gene, a.label, b.label AS other, a.n, b.n AS n_other, a.mean - b.mean AS log_fc,
                     (a.mean - b.mean) / sqrt(a.variance / a.n + b.variance / b.n) AS t,
                     pow(a.variance / a.n + b.variance / b.n, 2) / (pow(a.variance / a.n, 2) / (a.n - 1)
                         + pow(b.variance / b.n, 2) / (b.n - 1)) AS df
              FROM m a JOIN m b ON a.gene = b.gene AND a.label <> b.label),
        -- The tail beyond t by Simpson's rule on 1000 steps of the density from 0 to |t|.
        k AS (SELECT k, CASE WHEN k IN (0, 1000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END AS c FROM range(1001) AS x(k)),
        s AS (SELECT gene, label, other, sum(c * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(pi() * df)
                  - (df + 1) / 2 * ln(1 + pow(t * k / 1000, 2) / df))) * abs(t) / 3000 AS area FROM w, k GROUP BY gene, label, other, t)
        SELECT gene, label, other, n, n_other, round(log_fc, 6) AS log_fc, round(t, 6) AS t, round(df, 4) AS df,
               round(0.5 - sign(t) * area, 6) AS p_value FROM w JOIN s USING (gene, label, other)""",
)
def _(t: Tables):
    tested = markers.marker_ttest(customer_expr(t), customer_cells(t), "label")
    return tested.withColumns({"log_fc": r("log_fc"), "t": r("t"), "df": r("df", 4), "p_value": r("p_value")})


@query("S1_S4_markers_combined")
def _(t: Tables):
    pairs = markers.marker_ttest(customer_expr(t), customer_cells(t), "label")
    return markers.combine_markers(pairs, "label", "log_fc")


@query(
    "S4_combine_pairwise_tests",
    """WITH p AS (SELECT l_suppkey AS gene, l_returnflag AS label, CAST(l_linenumber AS VARCHAR) AS other,
                         round(avg(l_tax) * 10, 6) AS p_value, round(avg(l_quantity), 6) AS effect FROM lineitem GROUP BY ALL),
            k AS (SELECT *, row_number() OVER (PARTITION BY label, other ORDER BY p_value, gene) AS rk,
                         row_number() OVER (PARTITION BY label, gene ORDER BY p_value, other) AS i,
                         count(*) OVER (PARTITION BY label, gene) AS m FROM p),
            c AS (SELECT label, gene, min(rk) AS top, least(1.0, min(m * p_value / i)) AS p,
                         max(effect) FILTER (WHERE i = 1) AS summary_effect FROM k GROUP BY ALL),
            f AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p, gene) AS j, count(*) OVER (PARTITION BY label) AS n
                  FROM c)
       SELECT label, gene, top, round(p, 9) AS p_value, summary_effect,
              round(least(1.0, min(n * p / j) OVER (PARTITION BY label ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 9)
              AS fdr FROM f""",
)
def _(t: Tables):
    pairs = t.lineitem.groupBy(
        F.col("l_suppkey").alias("gene"), F.col("l_returnflag").alias("label"), F.col("l_linenumber").cast("string").alias("other")
    ).agg(r(F.avg("l_tax") * 10).alias("p_value"), r(F.avg("l_quantity")).alias("effect"))
    combined = markers.combine_markers(pairs, "label", "effect")
    return combined.withColumns({"p_value": r("p_value", 9), "fdr": r("fdr", 9)})


def _wilcox_sql(shift: float) -> str:
    return f"""
    WITH e AS ({CUSTOMER_EXPR}),
         z AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL),
         d AS (SELECT c_custkey AS cell_id, c_mktsegment AS label, gs.gene, coalesce(logcount, 0) AS x
               FROM customer CROSS JOIN (SELECT DISTINCT gene FROM e) gs
               LEFT JOIN e ON e.cell_id = c_custkey AND e.gene = gs.gene),
         h AS (SELECT gene, label, x, count(*) AS n FROM d GROUP BY ALL),
         p AS (SELECT h.gene, h.label, o.label AS other, h.x AS pos, h.n AS n, 0 AS m FROM h JOIN z o ON o.label <> h.label
               UNION ALL SELECT h.gene, o.label, h.label, h.x + {shift}, 0, h.n FROM h JOIN z o ON o.label <> h.label),
         g AS (SELECT gene, label, other, pos, sum(n) AS n, sum(m) AS m FROM p GROUP BY ALL),
         c AS (SELECT *, sum(m) OVER (PARTITION BY gene, label, other ORDER BY pos) - m / 2.0 AS below FROM g),
         u AS (SELECT gene, label, other, sum(n) AS n, sum(m) AS n_other, sum(n * below) AS u,
                      sum(pow(n + m, 3) - (n + m)) AS ties FROM c GROUP BY ALL)
    SELECT gene, label, other, CAST(n AS BIGINT) AS n, CAST(n_other AS BIGINT) AS n_other, CAST(u AS DOUBLE) AS u,
           round(u / (n * n_other), 9) AS auc,
           round((u - n * n_other / 2.0 - 0.5) / sqrt(n * n_other / 12.0 * (n + n_other + 1
                 - ties / ((n + n_other) * (n + n_other - 1.0)))), 6) AS z FROM u"""


@query("S2_marker_wilcoxon", _wilcox_sql(0.0))
def _(t: Tables):
    tested = markers.marker_wilcox(customer_expr(t), customer_cells(t), "label", with_p=False)
    return tested.drop("tie_sum").withColumns({"auc": r("auc", 9), "z": r("z")})


@query("S2_marker_wilcoxon_lfc", _wilcox_sql(5.0))
def _(t: Tables):
    tested = markers.marker_wilcox(customer_expr(t), customer_cells(t), "label", lfc=5.0, with_p=False)
    return tested.drop("tie_sum").withColumns({"auc": r("auc", 9), "z": r("z")})


@query("S2_S4_T3_top_markers")
def _(t: Tables):
    pairs = markers.marker_wilcox(customer_expr(t), customer_cells(t), "label", lfc=1.0)
    combined = markers.combine_markers(pairs, "label", "auc")
    return tidy.significant(combined, "fdr", 1.01)


def _sample_means(t: Tables):
    """Mean value per user in each event type: feature = day of month."""
    return t.events.groupBy(
        F.dayofmonth("ts").cast("bigint").alias("feature"), F.col("user_id").alias("sample_name"), F.col("event_type").alias("sample_type")
    ).agg(r(F.avg("value"), 6).alias("score"))


_PAIRWISE = """
    WITH s AS (SELECT dayofmonth(ts) AS feature, user_id, event_type AS g, round(avg(value), 6) AS x FROM events GROUP BY ALL),
         k AS (SELECT feature, g FROM s GROUP BY ALL HAVING count(*) >= 2),
         d AS (SELECT s.* FROM s JOIN k USING (feature, g)),
         pr AS (SELECT a.feature, a.g AS g1, b.g AS g2 FROM k a JOIN k b ON a.feature = b.feature AND a.g < b.g),
         v AS (SELECT pr.feature, g1, g2, g = g1 AS is1, x FROM pr JOIN d ON d.feature = pr.feature AND d.g IN (g1, g2)),
         w AS (SELECT *, rank() OVER (PARTITION BY feature, g1, g2 ORDER BY x)
                      + (count(*) OVER (PARTITION BY feature, g1, g2, x) - 1) / 2.0 AS rk,
                      count(*) OVER (PARTITION BY feature, g1, g2, x) AS t FROM v),
         u AS (SELECT feature, g1, g2, count(*) FILTER (WHERE is1) AS n1, count(*) FILTER (WHERE NOT is1) AS n2,
                      sum(rk) FILTER (WHERE is1) AS rs, sum(t * t - 1) AS ties FROM w GROUP BY ALL)
    SELECT feature, g1 AS group_1, g2 AS group_2, n1 AS n_1, n2 AS n_2, rs - n1 * (n1 + 1) / 2.0 AS u,
           CAST(ties AS DOUBLE) AS tie_sum,
           round((rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0 - 0.5 * sign(rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0))
                 / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z FROM u"""


@query("S3_C8_pairwise_rank_sums", _PAIRWISE)
def _(t: Tables):
    tested = markers.pairwise_ranksum(_sample_means(t), "score", "sample_type", ["feature"], with_p=False)
    return tested.withColumn("z", r("z"))


@query("S3_W5_pairwise_tests_holm")
def _(t: Tables):
    return markers.pairwise_ranksum(_sample_means(t), "score", "sample_type", ["feature"])


@query("S3_F3_cohorts_in_one_query")
def _(t: Tables):
    """All samples, and those with and without an outcome, as families of one call."""
    outcome = F.when(F.col("sample_name") % 2 == 0, F.lit("yes")).otherwise(F.lit("no"))
    labelled = _sample_means(t).withColumn("cohort", F.explode(F.array(F.lit("all"), outcome)))
    return markers.pairwise_ranksum(labelled, "score", "sample_type", ["cohort", "feature"])


# --- enrichment -------------------------------------------------------------------------


def _annotations(t: Tables):
    return t.documents.select(F.col("source").alias("term"), F.col("doc_id").alias("gene"))


def _hits(t: Tables):
    flagged = t.labels.filter((F.col("quality") == 0) | (F.col("toxic") == 1))
    return flagged.join(t.documents, "doc_id").select("lang", F.col("doc_id").alias("gene"))


_ENRICH = """
    WITH h AS (SELECT DISTINCT lang, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 0 OR toxic = 1),
         nn AS (SELECT lang, count(*) AS n FROM h GROUP BY ALL),
         kk AS (SELECT source AS term, count(DISTINCT doc_id) AS bigk FROM documents GROUP BY ALL
                HAVING count(DISTINCT doc_id) BETWEEN 10 AND 5000),
         k AS (SELECT h.lang, source AS term, count(*) AS k FROM h JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT k.lang, k.term, k.k, nn.n, kk.bigk, (SELECT count(DISTINCT doc_id) FROM documents) AS bign
    FROM k JOIN nn USING (lang) JOIN kk USING (term)"""


@query(
    "S11_enrichment",
    f"""WITH c AS ({_ENRICH}),
             i AS (SELECT c.*, unnest(generate_series(k, least(n, bigk))) AS i FROM c),
             l AS (SELECT lang, term, k, n, bigk, bign, sum(exp(lgamma(bigk + 1) - lgamma(i + 1) - lgamma(bigk - i + 1)
                   + lgamma(bign - bigk + 1) - lgamma(n - i + 1) - lgamma(bign - bigk - n + i + 1)
                   - lgamma(bign + 1) + lgamma(n + 1) + lgamma(bign - n + 1))) AS p FROM i GROUP BY ALL),
             j AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, term) AS j,
                          count(*) OVER (PARTITION BY lang) AS m,
                          least(1.0, count(*) FILTER (WHERE p >= 0.05) OVER (PARTITION BY lang)
                                     / (0.95 * count(*) OVER (PARTITION BY lang))) AS pi0 FROM l),
             b AS (SELECT *, min(m * p / j) OVER (PARTITION BY lang ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING)
                   AS bh FROM j)
        SELECT lang, term, k || '/' || n AS gene_ratio, bigk || '/' || bign AS bg_ratio, round(p, 9) AS p_value,
               round(least(1.0, bh), 9) AS adj_p_value, round(pi0 * least(1.0, bh), 9) AS q_value FROM b""",
)
def _(t: Tables):
    result = enrich.enrich(
        _hits(t), _annotations(t), ["lang"], min_size=10, max_size=5000, p_cutoff=None, q_cutoff=None
    )
    shown = result.select("lang", "term", "gene_ratio", "bg_ratio", "p_value", "adj_p_value", "q_value")
    return shown.withColumns({c: r(c, 9) for c in ("p_value", "adj_p_value", "q_value")})


@query("S11_C10_readable_enrichment")
def _(t: Tables):
    symbols = t.documents.select(F.col("doc_id").alias("gene"), F.concat(F.lit("doc"), "doc_id").alias("symbol"))
    return enrich.enrich(
        _hits(t), _annotations(t), ["lang"], symbols=symbols, max_size=5000, p_cutoff=None, q_cutoff=None
    )


# --- pseudobulk -------------------------------------------------------------------------


def order_expr(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell_id"),
        F.col("p_name").alias("gene"),
        F.col("l_quantity").cast("bigint").alias("count"),
    )


def order_cells(t: Tables):
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("cell_id"), F.col("n_name").alias("sample"), "o_orderstatus", "n_regionkey")
    )


def nation_bulk(t: Tables):
    return pseudobulk.pseudobulk(order_expr(t), order_cells(t), ["sample"])


NATION_BULK = """SELECT n_name AS sample, p_name AS gene, CAST(sum(l_quantity) AS DOUBLE) AS count FROM lineitem
                 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                 JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL"""


def nation_samples(t: Tables):
    return t.nation.select(F.col("n_name").alias("sample"), F.col("n_regionkey").cast("string").alias("group"))


@query(
    "D8_pseudobulk",
    """WITH z AS (SELECT n_name AS sample, o_orderstatus, count(*) AS n_cells FROM orders
                  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
       SELECT n_name AS sample, o_orderstatus, p_name AS gene, CAST(sum(l_quantity) AS BIGINT) AS count, any_value(n_cells) AS n_cells
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
       JOIN z USING (o_orderstatus) WHERE z.sample = n_name GROUP BY ALL""",
)
def _(t: Tables):
    return pseudobulk.pseudobulk(order_expr(t), order_cells(t), ["sample", "o_orderstatus"])


_LIBS = f"b AS ({NATION_BULK}), l AS (SELECT sample, sum(count) AS lib_size FROM b GROUP BY ALL)"


# Part numbers by their number of binary digits: each such gene is twice as abundant as the one before it.
_DECADES = """b AS (SELECT n_name AS sample, CAST(CAST(floor(log2(l_partkey + 1)) AS BIGINT) AS VARCHAR) AS gene, CAST(sum(l_quantity) AS DOUBLE) AS count
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
                    JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
              l AS (SELECT sample, sum(count) AS lib_size FROM b GROUP BY ALL)"""


def decade_bulk(t: Tables):
    expr = t.lineitem.select(
        F.col("l_orderkey").alias("cell_id"),
        F.floor(F.log2(F.col("l_partkey") + 1)).cast("string").alias("gene"),
        F.col("l_quantity").cast("bigint").alias("count"),
    )
    return pseudobulk.pseudobulk(expr, order_cells(t), ["sample"])


@query(
    "S5_expression_filter",
    f"""WITH {_DECADES}, c AS (SELECT 200 * 1e6 / median(lib_size) AS cut FROM l),
             m AS (SELECT min(n) AS need FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL)),
             k AS (SELECT gene FROM b JOIN l USING (sample), c, m GROUP BY gene, need
                   HAVING count(*) FILTER (WHERE count / lib_size * 1e6 >= cut) >= need AND sum(count) >= 15)
        SELECT sample, gene, CAST(count AS BIGINT) AS count FROM b WHERE gene IN (SELECT gene FROM k)""",
)
def _(t: Tables):
    kept = pseudobulk.filter_by_expr(decade_bulk(t), nation_samples(t), "group", min_count=200)
    return kept.select("sample", "gene", "count")


_TMM = f"""{_LIBS}, g AS (SELECT DISTINCT gene FROM b),
    q AS (SELECT l.sample, lib_size, quantile_cont(coalesce(count, 0), 0.75) / lib_size AS f FROM l CROSS JOIN g
          LEFT JOIN b ON b.sample = l.sample AND b.gene = g.gene GROUP BY l.sample, lib_size),
    r AS (SELECT sample AS ref FROM q ORDER BY abs(f - (SELECT avg(f) FROM q)), sample LIMIT 1),
    x AS (SELECT b.sample, b.count AS y, l.lib_size AS n, b0.count AS y0, l0.lib_size AS n0
          FROM b JOIN l USING (sample) JOIN b b0 ON b0.gene = b.gene AND b0.sample = (SELECT ref FROM r)
          JOIN l l0 ON l0.sample = b0.sample WHERE b.count > 0 AND b0.count > 0),
    m AS (SELECT sample, log2((y / n) / (y0 / n0)) AS m, (log2(y / n) + log2(y0 / n0)) / 2 AS a,
                 (n - y) / n / y + (n0 - y0) / n0 / y0 AS v FROM x),
    k AS (SELECT *, count(*) OVER (PARTITION BY sample) AS k,
                 rank() OVER (PARTITION BY sample ORDER BY m) + (count(*) OVER (PARTITION BY sample, m) - 1) / 2 AS rm,
                 rank() OVER (PARTITION BY sample ORDER BY a) + (count(*) OVER (PARTITION BY sample, a) - 1) / 2 AS ra FROM m),
    t AS (SELECT sample, sum(m / v) FILTER (WHERE rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3)
                         AND ra BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05))
                 / sum(1 / v) FILTER (WHERE rm BETWEEN floor(k * 0.3) + 1 AND k - floor(k * 0.3)
                         AND ra BETWEEN floor(k * 0.05) + 1 AND k - floor(k * 0.05)) AS f, max(abs(m)) AS top FROM k GROUP BY ALL),
    w AS (SELECT sample, CASE WHEN top < 1e-6 THEN 1 ELSE pow(2, f) END AS raw FROM t),
    tmm AS (SELECT sample, lib_size, raw / (SELECT exp(avg(ln(raw))) FROM w) AS norm_factor FROM w JOIN l USING (sample))"""


@query("S6_tmm_factors", f"WITH {_TMM} SELECT sample, lib_size, round(norm_factor, 6) AS norm_factor FROM tmm")
def _(t: Tables):
    return pseudobulk.tmm_factors(nation_bulk(t)).withColumn("norm_factor", r("norm_factor"))


@query(
    "S7_log_cpm",
    f"""WITH {_TMM}, e AS (SELECT sample, lib_size * norm_factor AS lib FROM tmm),
             p AS (SELECT sample, lib, 2 * lib / (SELECT avg(lib) FROM e) AS prior FROM e)
        SELECT p.sample, g.gene, round(log2((coalesce(count, 0) + prior) / (lib + 2 * prior) * 1e6), 6) AS log_cpm
        FROM p CROSS JOIN g LEFT JOIN b ON b.sample = p.sample AND b.gene = g.gene""",
)
def _(t: Tables):
    bulk = nation_bulk(t)
    return pseudobulk.log_cpm(bulk, pseudobulk.tmm_factors(bulk)).withColumn("log_cpm", r("log_cpm"))


@query(
    "T4_top_variable",
    f"""WITH e AS ({CUSTOMER_EXPR}), n AS (SELECT count(*) AS n FROM customer),
             v AS (SELECT gene, sum(logcount) / n AS mean, (sum(logcount * logcount) - sum(logcount) * sum(logcount) / n) / (n - 1)
                   AS variance FROM e, n GROUP BY gene, n)
        SELECT gene, round(mean, 6) AS mean, round(variance, 6) AS variance FROM v ORDER BY v.variance DESC, gene LIMIT 20""",
)
def _(t: Tables):
    top = pseudobulk.top_variable(customer_expr(t), customer_cells(t), 20)
    return top.withColumns({"mean": r("mean"), "variance": r("variance")})


@query(
    "T4_variance_residuals",
    """WITH e AS (SELECT l_partkey AS gene, l_orderkey AS cell, sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
            n AS (SELECT count(*) AS n FROM orders),
            v AS (SELECT gene, sum(x) / n AS mean, (sum(x * x) - sum(x) * sum(x) / n) / (n - 1) AS variance FROM e, n GROUP BY gene, n),
            l AS (SELECT *, ln(mean) AS lx, ln(variance) AS ly FROM v),
            w AS (SELECT min(lx) AS lo, (max(lx) - min(lx)) / 20 AS w FROM l),
            b AS (SELECT l.*, CAST(least(floor((lx - lo) / w), 19) AS BIGINT) AS bin FROM l, w)
       SELECT gene, round(mean, 8) AS mean, round(variance, 8) AS variance, bin,
              round(ly - avg(ly) OVER (PARTITION BY bin), 6) AS residual FROM b""",
)
def _(t: Tables):
    expr = t.lineitem.groupBy(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell_id")).agg(
        F.sum("l_quantity").alias("logcount")
    )
    n = t.orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    residuals = pseudobulk.variance_residuals(pseudobulk.gene_variances(expr, n))
    return residuals.withColumns({"mean": r("mean", 8), "variance": r("variance", 8), "residual": r("residual")})


# --- embeddings and neighbours ----------------------------------------------------------


def reference_vectors(t: Tables):
    return t.embeddings.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("ref_id"), "embedding", "label")


def query_vectors(t: Tables):
    return t.embeddings.filter("vec_id % 2 = 0").select(
        F.col("vec_id").alias("cell_id"), "embedding", (F.col("vec_id") % 7).alias("individual")
    )


_KNN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT q.vec_id AS cell_id, r.vec_id AS ref_id, r.label, list_distance(q.v, r.v) AS dist
          FROM e q JOIN e r ON q.vec_id % 2 = 0 AND r.vec_id % 2 = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, ref_id <= cell_id, ref_id) AS rk FROM d
          QUALIFY rk <= 10)"""


@query(
    "S18_nearest_neighbours",
    f"WITH {_KNN} SELECT cell_id, ref_id, CAST(rk AS INTEGER) AS rank, round(dist, 6) AS distance FROM k",
)
def _(t: Tables):
    return neighbours.nearest(query_vectors(t), reference_vectors(t), 10).withColumn("distance", r("distance"))


_LABELS = f"""{_KNN}, v AS (SELECT cell_id, label, count(*) AS votes, avg(dist) AS mean FROM k GROUP BY ALL),
    b AS (SELECT cell_id, label AS initial_label, round(votes / 10.0, 6) AS proba FROM v
          QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY votes DESC, mean, label) = 1)"""


@query("S18_label_transfer", f"WITH {_LABELS} SELECT * FROM b")
def _(t: Tables):
    labels = neighbours.knn_label_transfer(query_vectors(t), reference_vectors(t), 10)
    return labels.withColumn("proba", r("proba"))


_ERRORS = """c AS (SELECT label, list(m ORDER BY p) AS v FROM (
              SELECT label, p, avg(x) AS m FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x,
              unnest(generate_series(1, len(embedding))) AS p FROM embeddings WHERE vec_id % 2 = 1) GROUP BY ALL) GROUP BY label),
    n AS (SELECT vec_id AS cell_id, vec_id % 7 AS individual, c.label AS nearest_centroid,
                 list_distance(CAST(embedding AS DOUBLE[]), c.v) AS error FROM embeddings, c WHERE vec_id % 2 = 0
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY error, c.label) = 1),
    m AS (SELECT individual, median(error) AS med FROM n GROUP BY ALL),
    q AS (SELECT n.individual, med, 1.4826 * median(abs(error - med)) AS mad FROM n JOIN m USING (individual) GROUP BY ALL),
    f AS (SELECT cell_id, individual, nearest_centroid, error, CASE WHEN error > med + 1.5 * mad THEN 'Fail' ELSE 'Pass' END AS qc
          FROM n JOIN q USING (individual))"""


@query(
    "S17_mapping_error",
    f"WITH {_ERRORS} SELECT cell_id, individual, nearest_centroid, round(error, 6) AS error, qc FROM f",
)
def _(t: Tables):
    errors = neighbours.mapping_error(query_vectors(t), reference_vectors(t), ["individual"], threshold=1.5)
    return errors.select("cell_id", "individual", "nearest_centroid", r("error").alias("error"), "qc")


@query(
    "S17_S18_final_labels",
    f"""WITH {_LABELS}, {_ERRORS}
        SELECT cell_id, initial_label, proba, CASE WHEN qc = 'Pass' THEN initial_label END AS final_label,
               CASE WHEN qc = 'Pass' THEN proba END AS final_proba FROM b JOIN f USING (cell_id)""",
)
def _(t: Tables):
    errors = neighbours.mapping_error(query_vectors(t), reference_vectors(t), ["individual"], threshold=1.5)
    labels = neighbours.knn_label_transfer(query_vectors(t), reference_vectors(t), 10)
    final = neighbours.with_quality(labels, errors).drop("qc")
    return final.withColumns({"proba": r("proba"), "final_proba": r("final_proba")})


_PART_LOGS = """e AS (SELECT l_partkey AS gene, l_orderkey AS cell, sum(l_quantity) AS x FROM lineitem GROUP BY ALL),
            n AS (SELECT count(*) AS n FROM orders),
            v AS (SELECT gene, sum(x) / n AS mean, (sum(x * x) - sum(x) * sum(x) / n) / (n - 1) AS variance FROM e, n GROUP BY gene, n),
            l AS (SELECT *, ln(mean) AS lx, ln(variance) AS ly FROM v), ends AS (SELECT min(lx) AS lo, max(lx) AS hi FROM l)"""


@query(
    "T4_trended_residuals",
    f"""WITH {_PART_LOGS},
            k AS (SELECT i, lo + (hi - lo) * i / 4.0 AS place, (hi - lo) / 2.0 AS width FROM ends, range(5) AS x(i)),
            w AS (SELECT i, place, lx - place AS d, ly, pow(greatest(1 - pow(abs(lx - place) / width, 3), 0), 3) AS w FROM l, k),
            m AS (SELECT i, place, sum(w) AS s0, sum(w * d) AS s1, sum(w * d * d) AS s2, sum(w * ly) AS t0, sum(w * d * ly) AS t1
                  FROM w GROUP BY ALL),
            f AS (SELECT i, place, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS f FROM m),
            p AS (SELECT l.*, least(floor(4 * (lx - lo) / (hi - lo)), 3) AS i FROM l, ends),
            r AS (SELECT p.*, a.f + (b.f - a.f) * (lx - a.place) / (b.place - a.place) AS trend
                  FROM p JOIN f a ON a.i = p.i JOIN f b ON b.i = p.i + 1)
        SELECT gene, round(mean, 8) AS mean, round(variance, 8) AS variance, round(trend, 6) AS trend, round(ly - trend, 6) AS residual
        FROM r""",
)
def _(t: Tables):
    expr = t.lineitem.groupBy(F.col("l_partkey").alias("gene"), F.col("l_orderkey").alias("cell_id")).agg(
        F.sum("l_quantity").alias("logcount")
    )
    n = t.orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    variances = materialised(pseudobulk.gene_variances(expr, n))
    low, high = variances.agg(F.min(F.log("mean")), F.max(F.log("mean"))).first()
    knots = trend.Knots(np.linspace(low, high, 5), np.full(5, (high - low) / 2.0))
    residuals = pseudobulk.trended_residuals(variances, knots=knots)
    rounded = {"mean": r("mean", 8), "variance": r("variance", 8), "trend": r("trend"), "residual": r("residual")}
    return residuals.withColumns(rounded)


@query("S14_cell_pca")
def _(t: Tables):
    scores, _ = embed.cell_pca(t.embeddings, 20, cell="vec_id")
    return scores.select("vec_id", *[F.get("pca", F.lit(i)).alias(f"PC{i + 1}") for i in range(20)])


@query("S14_T4_variable_gene_pca")
def _(t: Tables):
    genes = [row[0] for row in pseudobulk.top_variable(customer_expr(t), customer_cells(t), 30).collect()]
    vectors = embed.cell_vectors(t.customer.select(F.col("c_custkey").alias("cell_id")), customer_expr(t), genes)
    return embed.cell_pca(vectors, 5)[0]


_LOADINGS = """SELECT p_name AS gene, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd, avg(l_discount) AS w1,
                      avg(l_tax) AS w2, avg(l_extendedprice) / 100000 AS w3 FROM lineitem JOIN part ON l_partkey = p_partkey
               GROUP BY ALL"""


def part_loadings(t: Tables):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    weights = F.array(F.avg("l_discount"), F.avg("l_tax"), F.avg("l_extendedprice") / 100000)
    return joined.groupBy(F.col("p_name").alias("gene")).agg(
        F.avg("l_quantity").alias("mean"), F.stddev_samp("l_quantity").alias("sd"), weights.alias("weights")
    )


_PROJECTED = f"""e AS ({CUSTOMER_EXPR}), w AS ({_LOADINGS}),
    p AS (SELECT c_custkey AS cell_id, c_nationkey AS nation, sum((coalesce(logcount, 0) - mean) / sd * w1) AS c1,
                 sum((coalesce(logcount, 0) - mean) / sd * w2) AS c2, sum((coalesce(logcount, 0) - mean) / sd * w3) AS c3
          FROM customer CROSS JOIN w LEFT JOIN e ON e.cell_id = c_custkey AND e.gene = w.gene GROUP BY ALL)"""


@query(
    "S16_project_on_reference",
    f"WITH {_PROJECTED} SELECT cell_id, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM p",
)
def _(t: Tables):
    placed = embed.project(customer_expr(t), customer_cells(t), part_loadings(t), 3)
    return placed.select("cell_id", *[r(F.get("embedding", F.lit(i))).alias(f"c{i + 1}") for i in range(3)])


@query(
    "S16_align_donors",
    f"""WITH {_PROJECTED} SELECT cell_id, round(c1 + (SELECT avg(c1) FROM p) - avg(c1) OVER (PARTITION BY nation), 6) AS c1,
               round(c2 + (SELECT avg(c2) FROM p) - avg(c2) OVER (PARTITION BY nation), 6) AS c2,
               round(c3 + (SELECT avg(c3) FROM p) - avg(c3) OVER (PARTITION BY nation), 6) AS c3 FROM p""",
)
def _(t: Tables):
    placed = embed.project(customer_expr(t), customer_cells(t), part_loadings(t), 3)
    moved = embed.align_donors(placed, "nation")
    return moved.select("cell_id", *[r(F.get("embedding", F.lit(i))).alias(f"c{i + 1}") for i in range(3)])


@query("S16_align_donors_softly")
def _(t: Tables):
    placed = embed.project(customer_expr(t), customer_cells(t), part_loadings(t), 3)
    moved = donors.align_donors_softly(placed, "nation", clusters=8, rounds=2, steps=1)
    return moved.select("cell_id", *[r(F.get("embedding", F.lit(i))).alias(f"c{i + 1}") for i in range(3)])


@query(
    "S16_cluster_shifts",
    f"""WITH {_PROJECTED},
        m AS (SELECT (c1 > 0)::INT + 2 * (c2 > 0)::INT AS cluster, nation, count(*)::DOUBLE AS n,
                     sum(c1) AS s1, sum(c2) AS s2, sum(c3) AS s3 FROM p GROUP BY ALL),
        u AS (SELECT cluster, sum(n / (n + 2)) AS w, sum(s1 / (n + 2)) AS u1, sum(s2 / (n + 2)) AS u2, sum(s3 / (n + 2)) AS u3
              FROM m GROUP BY cluster)
        SELECT cluster, nation, round((s1 - n * u1 / w) / (n + 2), 6) AS shift1, round((s2 - n * u2 / w) / (n + 2), 6) AS shift2,
               round((s3 - n * u3 / w) / (n + 2), 6) AS shift3 FROM m JOIN u USING (cluster)""",
)
def _(t: Tables):
    placed = embed.project(customer_expr(t), customer_cells(t), part_loadings(t), 3)
    at = [F.get("embedding", F.lit(i)) for i in range(3)]
    cluster = ((at[0] > 0).cast("int") + 2 * (at[1] > 0).cast("int")).alias("cluster")
    moments = placed.groupBy(cluster, "nation").agg(
        F.count("*").cast("double").alias("n"), F.array(*[F.sum(x) for x in at]).alias("s")
    )
    shifts = donors.ridge_shifts(moments, 2.0, donor="nation")
    return shifts.select("cluster", "nation", *[r(F.get("shift", F.lit(i))).alias(f"shift{i + 1}") for i in range(3)])


def nation_profiles(t: Tables):
    """Mean quantity per nation and part name."""
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("sample"), F.col("p_name").alias("gene"))
        .agg(F.avg("l_quantity").alias("mean"))
    )


_PROFILES = """p AS (SELECT n_name AS sample, p_name AS gene, avg(l_quantity) AS mean FROM lineitem
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


@query(
    "S21_profile_distances",
    f"""WITH {_PROFILES}, i AS (SELECT DISTINCT sample FROM p), g AS (SELECT DISTINCT gene FROM p),
             f AS (SELECT i.sample, g.gene, coalesce(mean, 0) AS mean FROM i CROSS JOIN g LEFT JOIN p USING (sample, gene))
        SELECT a.sample AS id_1, b.sample AS id_2, round(sqrt(sum(pow(a.mean - b.mean, 2))), 6) AS distance
        FROM f a JOIN f b ON a.gene = b.gene AND a.sample < b.sample GROUP BY ALL""",
)
def _(t: Tables):
    return embed.profile_distances(nation_profiles(t), "sample", "gene", "mean").withColumn("distance", r("distance"))


@query(
    "S15_sample_gram",
    f"""WITH {_PROFILES}, z AS (SELECT sample, gene, (mean - avg(mean) OVER (PARTITION BY gene))
                                / nullif(stddev_samp(mean) OVER (PARTITION BY gene), 0) AS x FROM p)
        SELECT a.sample AS id_1, b.sample AS id_2, round(sum(a.x * b.x), 6) AS product FROM z a JOIN z b
        ON a.gene = b.gene AND a.sample <= b.sample WHERE a.x IS NOT NULL GROUP BY ALL""",
)
def _(t: Tables):
    return embed.sample_gram(nation_profiles(t), value="mean").withColumn("product", r("product"))


@query("S15_sample_pca")
def _(t: Tables):
    bulk = nation_bulk(t)
    return embed.sample_pca(pseudobulk.log_cpm(bulk, pseudobulk.tmm_factors(bulk)))


_SNN = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    d AS (SELECT q.vec_id AS a, o.vec_id AS via, list_distance(q.v, o.v) AS dist FROM e q JOIN e o ON q.vec_id <> o.vec_id),
    k AS (SELECT a, via, row_number() OVER (PARTITION BY a ORDER BY dist, via <= a, via) AS rk FROM d QUALIFY rk <= 10),
    l AS (SELECT * FROM k UNION ALL SELECT vec_id, vec_id, 0 FROM e)"""


@query(
    "S19_shared_neighbour_graph",
    f"""WITH {_SNN} SELECT x.a AS src, y.a AS dst, greatest(10 - min(x.rk + y.rk) / 2.0, 1e-6) AS weight
        FROM l x JOIN l y ON x.via = y.via AND x.a < y.a GROUP BY ALL""",
)
def _(t: Tables):
    return graph.snn_graph(t.embeddings.select("vec_id", "embedding"), 10, node="vec_id")


@query(
    "S19_jaccard_graph",
    f"""WITH {_SNN} SELECT x.a AS src, y.a AS dst, round(count(*) / (22.0 - count(*)), 9) AS weight
        FROM l x JOIN l y ON x.via = y.via AND x.a < y.a GROUP BY ALL""",
)
def _(t: Tables):
    edges = graph.snn_graph(t.embeddings.select("vec_id", "embedding"), 10, node="vec_id", weighting="jaccard")
    return edges.withColumn("weight", r("weight", 9))


def embedding_communities(t: Tables):
    edges = graph.snn_graph(t.embeddings.select("vec_id", "embedding"), 10, node="vec_id")
    return graph.communities(edges)


@query("S20_communities")
def _(t: Tables):
    return embedding_communities(t)


@query(
    "S20_modularity",
    """WITH e AS (SELECT o_custkey % 150 AS src, (o_orderkey * 7) % 150 AS dst, o_totalprice / 1000 AS weight FROM orders),
            n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), p AS (SELECT node, node % 6 AS c FROM n),
            m AS (SELECT a.c AS ca, b.c AS cb, weight FROM e JOIN p a ON e.src = a.node JOIN p b ON e.dst = b.node),
            d AS (SELECT c, sum(weight) AS d FROM (SELECT ca AS c, weight FROM m UNION ALL SELECT cb, weight FROM m) GROUP BY ALL)
       SELECT round(sum(weight) FILTER (WHERE ca = cb) / sum(weight)
              - (SELECT sum(d * d) FROM d) / (4 * sum(weight) * sum(weight)), 9) AS modularity FROM m""",
)
def _(t: Tables):
    edges = t.orders.select(
        (F.col("o_custkey") % 150).alias("src"),
        ((F.col("o_orderkey") * 7) % 150).alias("dst"),
        (F.col("o_totalprice") / 1000).alias("weight"),
    )
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    parts = nodes.withColumn("community", F.col("node") % 6)
    return graph.modularity(edges, parts).withColumn("modularity", r("modularity", 9))


# --- differential expression ------------------------------------------------------------


def _status_bulk(t: Tables):
    """Pseudobulk per region and order status: regions are the patients, statuses the groups."""
    cells = order_cells(t).select(
        "cell_id",
        F.concat_ws("_", F.col("n_regionkey").cast("string"), "o_orderstatus").alias("sample"),
        F.col("n_regionkey").cast("string").alias("patient"),
        F.col("o_orderstatus").alias("group"),
    )
    samples = cells.select("sample", "patient", "group").distinct()
    return pseudobulk.pseudobulk(order_expr(t), cells, ["sample"]), samples


@query("S8_dispersion")
def _(t: Tables):
    bulk, samples = _status_bulk(t)
    design = glm.design_matrix(samples, {"patient": None, "group": "F"})
    return glm.estimate_dispersion(bulk, pseudobulk.tmm_factors(bulk), design)


_CURVE_POINTS = (3, 10, 15)


@query(
    "S8_profile_curve",
    f"""WITH RECURSIVE {_LIBS}, g AS (SELECT DISTINCT gene FROM b),
        y AS (SELECT gene, n_regionkey AS grp, list(coalesce(count, 0) ORDER BY l.sample) AS y, list(lib_size ORDER BY l.sample) AS lib
              FROM g CROSS JOIN l JOIN nation ON n_name = l.sample LEFT JOIN b USING (gene, sample) GROUP BY ALL),
        fit AS (
            SELECT gene, grp, phi, y, lib, 0 AS k, (list_sum(y) + 0.5) / list_sum(lib) AS rate
            FROM y, (SELECT 0.1 * pow(2.0, unnest({[i - 10 for i in _CURVE_POINTS]})) AS phi)
            UNION ALL
            SELECT gene, grp, phi, y, lib, k + 1, rate * exp(
                list_sum(list_transform(list_zip(y, lib), lambda p: (p[1] - rate * p[2]) / (1 + phi * rate * p[2])))
                / list_sum(list_transform(lib, lambda v: rate * v / (1 + phi * rate * v)))) FROM fit WHERE k < 25),
        d AS (SELECT gene, phi,
                  list_sum(list_transform(list_zip(y, lib), lambda p: lgamma(p[1] + 1 / phi) - lgamma(1 / phi) - lgamma(p[1] + 1)
                      - ln(1 + phi * rate * p[2]) / phi + p[1] * (ln(phi * rate * p[2]) - ln(1 + phi * rate * p[2]))))
                  - 0.5 * ln(list_sum(list_transform(lib, lambda v: greatest(rate * v / (1 + phi * rate * v), 1e-6)))) AS part
              FROM fit WHERE k = 25)
        SELECT gene, round(phi, 9) AS phi, round(sum(part), 3) AS likelihood FROM d GROUP BY gene, phi""",
)
def _(t: Tables):
    bulk = materialised(nation_bulk(t))
    libraries = pseudobulk.library_sizes(bulk).withColumn("norm_factor", F.lit(1.0))
    design = glm.design_matrix(nation_samples(t), {"group": "0"})
    grid = [float(glm.GRID[i]) for i in _CURVE_POINTS]
    curves = glm.profile_curves(bulk, libraries, design, grid=grid)
    points = F.arrays_zip(F.array(*[F.lit(round(x, 9)) for x in grid]).alias("phi"), F.col("curve").alias("v"))
    return curves.select("gene", F.explode(points).alias("p")).select("gene", "p.phi", r("p.v", 3).alias("likelihood"))


@query("S9_S10_paired_de")
def _(t: Tables):
    bulk, samples = _status_bulk(t)
    kept = materialised(pseudobulk.filter_by_expr(bulk, samples, "group"))
    design = glm.design_matrix(samples, {"patient": None, "group": "F"})
    contrasts = {"O vs F": "groupO", "P vs F": "groupP", "P vs O": {"groupP": 1.0, "groupO": -1.0}}
    return glm.pseudobulk_de(kept, pseudobulk.tmm_factors(kept), design, contrasts)


@query("S9_S10_unpaired_de_bh")
def _(t: Tables):
    bulk = materialised(nation_bulk(t))
    design = glm.design_matrix(nation_samples(t), {"group": "0"})
    tests = {f"{g} vs 0": f"group{g}" for g in "1234"}
    return glm.pseudobulk_de(bulk, pseudobulk.tmm_factors(bulk), design, tests, method="BH")
