"""Signature scores per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _signature_list(signatures: DataFrame, signature: str, gene: str):
    """All signatures with their number of genes in one array; signatures are few."""
    sized = signatures.groupBy(signature).agg(F.countDistinct(gene).alias("n"))
    return sized.agg(F.array_sort(F.collect_list(F.struct(F.col(signature).alias("s"), "n"))).alias("l")).scalar()


def signature_summary(
    cells: DataFrame,
    expr: DataFrame,
    signatures: DataFrame,
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    signature: str = "signature",
) -> DataFrame:
    """Sum and mean over all genes of a signature, per cell and signature.

    Genes without a stored value count as zero.  ``signatures`` lists detected genes (see
    ``tidy.present_features``); a gene listed twice counts once.
    """
    wanted = signatures.select(signature, gene).distinct()
    sums = expr.join(wanted, gene).groupBy(cell, signature).agg(F.sum(value).alias("v"))
    per_cell = sums.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct(signature, "v"))).alias("__sums"))
    listed = (
        cells.join(per_cell, cell, "left")
        .withColumn("__list", _signature_list(wanted, signature, gene))
        .withColumn("__s", F.explode("__list"))
    )
    total = F.coalesce(F.try_element_at("__sums", F.col("__s.s")), F.lit(0.0))
    return listed.withColumns(
        {
            signature: F.col("__s.s"),
            "signature_sum": total,
            "signature_mean": total / F.col("__s.n"),
        }
    ).drop("__s", "__list", "__sums")


def rank_score(
    cells: DataFrame,
    expr: DataFrame,
    signatures: DataFrame,
    n_features: int,
    *,
    max_rank: int = 1500,
    normaliser: str = "trimmed",
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    signature: str = "signature",
) -> DataFrame:
    """Rank-based signature score in [0, 1] per cell and signature.

    Genes are ranked within a cell from the highest value, ties at their mean rank.  Only
    stored values are ranked, at most ``n_features`` per cell; the genes without one share
    the rank right behind them, which needs no rows.  Ranks beyond ``max_rank`` become
    ``max_rank + 1`` and a signature that lies wholly there scores 0.

    ``normaliser``: the largest rank sum is ``n * max_rank - n(n+1)/2`` (``trimmed``) or
    ``n * max_rank`` (``plain``).
    """
    if normaliser not in ("trimmed", "plain"):
        raise ValueError("normaliser must be 'trimmed' or 'plain'")
    wanted = signatures.select(signature, gene).distinct()
    order = Window.partitionBy(cell).orderBy(F.desc(value))
    # The default frame ends with the last tie, so rank and count enclose the ties.
    upto = F.count(F.lit(1)).over(order)
    ranked = expr.filter(F.col(value) > 0).select(
        cell, gene, ((F.rank().over(order) + upto) / 2.0).alias("__rank"), upto.alias("__upto")
    )
    inside = F.col("__rank") <= max_rank
    capped = F.when(inside, F.col("__rank")).otherwise(F.lit(float(max_rank + 1)))
    sums = (
        ranked.join(wanted, gene, "left")
        .groupBy(cell, signature)
        .agg(
            F.sum(capped).alias("r"),
            F.count(F.lit(1)).alias("k"),
            F.count_if(inside).alias("i"),
            F.max("__upto").alias("__nnz"),
        )
    )
    entry = F.when(F.col(signature).isNotNull(), F.struct(signature, F.struct("r", "k", "i")))
    per_cell = sums.groupBy(cell).agg(
        F.map_from_entries(F.collect_list(entry)).alias("__ranks"), F.max("__nnz").alias("__nnz")
    )
    listed = (
        cells.join(per_cell, cell, "left")
        .withColumn("__list", _signature_list(wanted, signature, gene))
        .withColumn("__s", F.explode("__list"))
    )
    found = F.try_element_at("__ranks", F.col("__s.s"))
    n, k = F.col("__s.n"), F.coalesce(found["k"], F.lit(0))
    nnz = F.coalesce("__nnz", F.lit(0))
    shared = nnz + (F.lit(float(n_features)) - nnz + 1) / 2.0
    zero_rank = F.when(shared <= max_rank, shared).otherwise(F.lit(float(max_rank + 1)))
    rank_sum = F.coalesce(found["r"], F.lit(0.0)) + (n - k) * zero_rank
    any_inside = (F.coalesce(found["i"], F.lit(0)) > 0) | ((n > k) & (shared <= max_rank))
    triangle = n * (n + 1) / 2.0
    largest = n * F.lit(float(max_rank)) - (triangle if normaliser == "trimmed" else F.lit(0.0))
    score = F.when(any_inside, F.greatest(F.lit(0.0), 1.0 - F.try_divide(rank_sum - triangle, largest))).otherwise(0.0)
    return listed.withColumns({signature: F.col("__s.s"), "score": score}).drop("__s", "__list", "__ranks", "__nnz")
