"""Over-representation of terms in lists of genes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import hypergeometric_upper
from ..session import materialised
from .joins import terms_with_symbols
from .keyed import join_groups
from .multiple import adjust_p

STOREY_LAMBDA = 0.05


def term_counts(
    hits: DataFrame,
    term_genes: DataFrame,
    by: Sequence[str] = (),
    *,
    universe: DataFrame | None = None,
    term: str = "term",
    gene: str = "gene",
    min_size: int = 10,
    max_size: int = 500,
) -> DataFrame:
    """The four numbers of each test.

    ``n_hits`` of ``n_listed`` hits, and ``term_size`` of ``n_universe`` genes, are in the term.

    The universe is every annotated gene, or the annotated part of ``universe``.  Terms
    outside the size limits, and terms no hit belongs to, are not tested.
    """
    by = list(by)
    annotated = term_genes.select(term, gene).distinct()
    if universe is not None:
        annotated = annotated.join(universe.select(gene).distinct(), gene, "left_semi")
    listed = hits.select(*by, gene).distinct()
    used = listed.join(annotated.select(gene).distinct(), gene, "left_semi")
    sizes = annotated.groupBy(term).agg(F.count(F.lit(1)).alias("term_size")).filter(F.col("term_size").between(min_size, max_size))
    found = used.join(annotated, gene).groupBy(*by, term).agg(F.count(F.lit(1)).alias("n_hits"))
    totals = used.groupBy(*by).agg(F.count(F.lit(1)).alias("n_listed"))
    tested = found.join(sizes, term)
    tested = join_groups(tested, totals, by) if by else tested.withColumn("n_listed", totals.scalar())
    total = annotated.agg(F.countDistinct(gene).alias("n_universe")).scalar()
    return tested.withColumn("n_universe", total).select(
        *by, term, "n_hits", "n_listed", "term_size", "n_universe"
    )


def enrich(
    hits: DataFrame,
    term_genes: DataFrame,
    by: Sequence[str] = (),
    *,
    universe: DataFrame | None = None,
    symbols: DataFrame | None = None,
    term: str = "term",
    gene: str = "gene",
    symbol: str = "symbol",
    min_size: int = 10,
    max_size: int = 500,
    method: str = "BH",
    p_cutoff: float | None = 0.05,
    q_cutoff: float | None = 0.2,
) -> DataFrame:
    """Upper-tail hypergeometric test of every term for every list of hits.

    ``q_value`` is the BH value times the estimated share of true null hypotheses,
    ``#(p >= 0.05) / (0.95 m)`` capped at 1.  ``symbols`` (gene, symbol) adds the hits of each
    kept term as readable names.
    """
    by = list(by)
    counts = term_counts(
        hits, term_genes, by, universe=universe, term=term, gene=gene, min_size=min_size, max_size=max_size
    )
    # One row per tested term; kept, since the tails come from Python and are read three times.
    tested = materialised(
        counts.withColumn("p_value", hypergeometric_upper("n_hits", "n_universe", "term_size", "n_listed"))
    ).withColumns(
        {
            "gene_ratio": F.concat_ws("/", "n_hits", "n_listed"),
            "bg_ratio": F.concat_ws("/", "term_size", "n_universe"),
        }
    )
    adjusted = adjust_p(tested, "p_value", by, method)
    if method == "BH":
        with_bh = adjusted.withColumn("__bh", F.col("adj_p_value"))
    else:
        with_bh = adjust_p(adjusted, "p_value", by, "BH", adjusted="__bh", method_name=None)
    nulls = F.least(
        F.lit(1.0), F.count_if(F.col("p_value") >= STOREY_LAMBDA) / (F.count(F.lit(1)) * F.lit(1.0 - STOREY_LAMBDA))
    ).alias("__pi0")
    if by:
        scored = join_groups(with_bh, tested.groupBy(*by).agg(nulls), by)
    else:
        scored = with_bh.withColumn("__pi0", tested.agg(nulls).scalar())
    result = scored.withColumn("q_value", F.col("__pi0") * F.col("__bh")).drop("__pi0", "__bh")
    if p_cutoff is not None:
        result = result.filter((F.col("p_value") < p_cutoff) & (F.col("adj_p_value") < p_cutoff))
    if q_cutoff is not None:
        result = result.filter(F.col("q_value") < q_cutoff)
    if symbols is None:
        return result
    members = hits.select(*by, gene).distinct().join(term_genes.select(term, gene).distinct(), gene)
    kept = join_groups(members, result.select(*by, term), [*by, term], "left_semi")
    readable = terms_with_symbols(kept, symbols, [*by, term], gene, symbol, "genes")
    return join_groups(result, readable, [*by, term])
