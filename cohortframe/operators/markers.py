"""Marker tests between groups of cells and rank-sum tests between groups of samples.

Expression tables hold non-zero values only.  Every group size comes from the cells table, so
the zeros count in each mean, variance and rank without being stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import normal_upper, rank_sum_exact, t_upper
from .keyed import join_groups
from .multiple import adjust_p
from .ranksums import rank_sums
from .scan import BLOCK_ROWS, with_position


def _group_sizes(cells: DataFrame, strata: Sequence[str], group: str) -> DataFrame:
    """Per stratum the list of (group, cells); groups are few."""
    sizes = cells.filter(F.col(group).isNotNull()).groupBy(*strata, group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n"))).alias("__sizes"))


def _with_sizes(genes: DataFrame, cells: DataFrame, strata: Sequence[str], group: str) -> DataFrame:
    sizes = _group_sizes(cells, strata, group)
    if strata:
        return join_groups(genes, sizes, strata)
    return genes.withColumn("__sizes", sizes.scalar())


def group_moments(
    expr: DataFrame,
    cells: DataFrame,
    group: str,
    strata: Sequence[str] = (),
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
) -> DataFrame:
    """n, mean and variance with zeros per (stratum, gene, group), every group of a gene listed.

    One pass over the expression values; the spread is that of the non-zeros plus the shift
    that the zeros cause, which avoids differences of large sums.
    """
    labelled = expr.join(cells.select(cell, *strata, group), cell).filter(F.col(group).isNotNull())
    stored = labelled.groupBy(*strata, gene, group).agg(
        F.count(F.lit(1)).alias("k"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("s")
    )
    per_gene = stored.groupBy(*strata, gene).agg(
        F.map_from_entries(F.collect_list(F.struct(group, F.struct("k", "m", "s")))).alias("__stored")
    )
    listed = _with_sizes(per_gene, cells, strata, group).withColumn("__size", F.explode("__sizes"))
    found = F.try_element_at("__stored", F.col("__size.g"))
    k, m, s = (F.coalesce(found[c], F.lit(0)) for c in ("k", "m", "s"))
    n = F.col("__size.n")
    spread = s + m * m * k * (n - k) / n
    return listed.select(
        *strata,
        gene,
        F.col("__size.g").alias(group),
        n.alias("n"),
        (m * k / n).alias("mean"),
        F.try_divide(spread, n - F.lit(1)).alias("variance"),
    )


def marker_ttest(
    expr: DataFrame,
    cells: DataFrame,
    group: str,
    strata: Sequence[str] = (),
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    with_p: bool = True,
) -> DataFrame:
    """Welch test of each group against each other group, one-sided for higher expression.

    Effect ``log_fc`` is the difference of the means.  All ordered pairs of groups are the
    result; they form from one aggregated row per gene and group.  A pair without variance or
    with a single cell has NULL statistics.
    """
    moments = group_moments(expr, cells, group, strata, cell=cell, gene=gene, value=value)
    sides = moments.groupBy(*strata, gene).agg(
        F.collect_list(F.struct(F.col(group).alias("g"), "n", "mean", "variance")).alias("__a")
    )
    pairs = (
        sides.withColumn("__b", F.col("__a"))
        .withColumn("__a", F.explode("__a"))
        .withColumn("__b", F.explode("__b"))
        .filter(F.col("__a.g") != F.col("__b.g"))
    )
    part = {s: F.try_divide(F.col(f"__{s}.variance"), F.col(f"__{s}.n")) for s in "ab"}
    total = part["a"] + part["b"]
    freedom = F.try_divide(
        total * total,
        part["a"] * part["a"] / (F.col("__a.n") - 1) + part["b"] * part["b"] / (F.col("__b.n") - 1),
    )
    difference = F.col("__a.mean") - F.col("__b.mean")
    tested = pairs.select(
        *strata,
        gene,
        F.col("__a.g").alias(group),
        F.col("__b.g").alias("other"),
        F.col("__a.n").alias("n"),
        F.col("__b.n").alias("n_other"),
        difference.alias("log_fc"),
        F.try_divide(difference, F.sqrt(total)).alias("t"),
        F.when((F.col("__a.n") > 1) & (F.col("__b.n") > 1), freedom).alias("df"),
    )
    if not with_p:
        return tested
    return tested.withColumn("p_value", F.when(F.col("t").isNotNull() & F.col("df").isNotNull(), t_upper("t", "df")))


def _z_parts(df: DataFrame) -> tuple:
    n, m = F.col("n").cast("double"), F.col("n_other").cast("double")
    size = n + m
    correction = F.coalesce(F.try_divide(F.col("tie_sum"), size * (size - 1)), F.lit(0.0))
    return F.col("u") - n * m / 2.0, F.sqrt(n * m / 12.0 * (size + 1 - correction))


def marker_wilcox(
    expr: DataFrame,
    cells: DataFrame,
    group: str,
    strata: Sequence[str] = (),
    *,
    lfc: float = 0.0,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    with_p: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rank-sum test of each group against each other group, one-sided for higher values.

    ``lfc`` moves the other group up before ranking, so a gene must exceed it by that much.
    Cells are first compressed to (gene, value, group, n) with one block of zeros per group.
    ``z`` carries the tie and continuity corrections.
    """
    labelled = expr.join(cells.select(cell, *strata, group), cell).filter(F.col(group).isNotNull() & (F.col(value) != 0))
    stored = labelled.groupBy(*strata, gene, group, value).agg(F.count(F.lit(1)).alias("n"))
    present = stored.groupBy(*strata, gene, group).agg(F.sum("n").alias("k"))
    per_gene = present.groupBy(*strata, gene).agg(
        F.map_from_entries(F.collect_list(F.struct(group, "k"))).alias("__stored")
    )
    listed = _with_sizes(per_gene, cells, strata, group).withColumn("__size", F.explode("__sizes"))
    zeros = listed.select(
        *strata,
        gene,
        F.col("__size.g").alias(group),
        F.lit(0.0).cast(stored.schema[value].dataType).alias(value),
        (F.col("__size.n") - F.coalesce(F.try_element_at("__stored", F.col("__size.g")), F.lit(0))).alias("n"),
    ).filter(F.col("n") > 0)
    counts = stored.unionByName(zeros)
    ranked = rank_sums(counts, [*strata, gene], group, value, shift=lfc, block_rows=block_rows)
    centre, sigma = _z_parts(ranked)
    tested = ranked.withColumns(
        {
            "auc": F.try_divide(F.col("u"), F.col("n").cast("double") * F.col("n_other")),
            "z": F.try_divide(centre - 0.5, sigma),
        }
    )
    if not with_p:
        return tested
    return tested.withColumn("p_value", F.when(F.col("z").isNull(), F.lit(1.0)).otherwise(normal_upper("z")))


def combine_markers(
    pairs: DataFrame,
    group: str,
    effect: str,
    strata: Sequence[str] = (),
    *,
    gene: str = "gene",
    p_col: str = "p_value",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per (stratum, group, gene) from its pairwise tests.

    Simes p-value, BH within the group, the effect of the strongest comparison, and ``top``,
    the best rank the gene reaches in any comparison.
    """
    strata = list(strata)
    ranked = with_position(
        pairs.filter(F.col(p_col).isNotNull()), [*strata, group, "other"], [p_col, gene], "__rank", block_rows=block_rows
    )
    # One p-value per other group.
    ordered = F.array_sort(F.collect_list(p_col))
    simes = F.array_min(
        F.transform(ordered, lambda p, i: F.least(F.lit(1.0), p * F.size(ordered) / (i + F.lit(1))))
    )
    combined = ranked.groupBy(*strata, group, gene).agg(
        F.min("__rank").alias("top"),
        simes.alias("p_value"),
        F.min_by(effect, F.struct(p_col, "other")).alias(f"summary_{effect}"),
    )
    return adjust_p(
        combined, "p_value", [*strata, group], "BH", adjusted="fdr", method_name=None, block_rows=block_rows
    )


def pairwise_ranksum(
    df: DataFrame,
    value: str,
    group: str,
    family: Sequence[str],
    *,
    min_n: int = 2,
    exact_below: int = 50,
    method: str = "holm",
    with_p: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Two-sided rank-sum test for every unordered pair of groups in each family.

    Groups with fewer than ``min_n`` values are left out.  Both sizes below ``exact_below``
    and no ties give the exact p-value, otherwise the normal one with continuity correction.
    ``u`` belongs to ``group_1``, the lower name.
    """
    family = list(family)
    known = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = known.groupBy(*family, group, value).agg(F.count(F.lit(1)).alias("n"))
    enough = counts.groupBy(*family, group).agg(F.sum("n").alias("__size")).filter(F.col("__size") >= min_n)
    usable = join_groups(counts, enough, [*family, group], "inner").drop("__size")
    ranked = rank_sums(usable, family, group, value, block_rows=block_rows).filter(F.col(group) < F.col("other"))
    centre, sigma = _z_parts(ranked)
    tested = ranked.withColumn("z", F.try_divide(centre - F.signum(centre) * 0.5, sigma)).withColumnsRenamed(
        {group: "group_1", "other": "group_2", "n": "n_1", "n_other": "n_2"}
    )
    if not with_p:
        return tested
    exact = (F.col("tie_sum") == 0) & (F.col("n_1") < exact_below) & (F.col("n_2") < exact_below)
    # Both columns are filled for every row; a row without need of the exact count asks for 1 against 1.
    u, n1, n2 = (F.when(exact, F.col(c)).otherwise(F.lit(1)) for c in ("u", "n_1", "n_2"))
    filled = tested.withColumns(
        {
            "__exact": rank_sum_exact(u.cast("double"), n1.cast("bigint"), n2.cast("bigint")),
            "__tail": normal_upper(F.coalesce(F.abs("z"), F.lit(0.0))),
        }
    )
    p = F.when(exact, F.col("__exact")).otherwise(F.least(F.lit(1.0), 2.0 * F.col("__tail")))
    named = filled.withColumn("p_value", p).drop("__exact", "__tail")
    return adjust_p(named, "p_value", family, method, block_rows=block_rows)
