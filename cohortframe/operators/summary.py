"""Group summaries, contingency tables, shares and z-scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import share
from ..session import materialised
from .joins import complete_levels
from .keyed import join_groups
from .scan import BLOCK_ROWS, exact_quantiles, quantiles_of_counts, value_counts


def crosstab(
    df: DataFrame,
    dims: Sequence[str],
    levels: Mapping[str, Sequence | DataFrame] | None = None,
    name: str = "n",
) -> DataFrame:
    """N-way contingency table with its zero cells; rows with a NULL dimension do not count."""
    known = df.dropna(subset=list(dims))
    return complete_levels(known.groupBy(*dims).agg(F.count(F.lit(1)).alias(name)), dims, [name], levels)


def share_of_total(
    df: DataFrame, value: str, by: Sequence[str], total_name: str = "total", share_name: str = "share"
) -> DataFrame:
    """Add the group total and each row's share of it; NULL share in an empty group.

    The total comes from a partial aggregate joined back, so a group that holds a large part
    of all rows is not gathered in one task.  ``df`` is read twice: pass counts, not cells.
    """
    totals = df.groupBy(*by).agg(F.sum(value).alias(total_name))
    return join_groups(df, totals, by).withColumn(share_name, share(value, total_name))


def composition(
    df: DataFrame,
    dims: Sequence[str],
    within: Sequence[str],
    where: Column | None = None,
    levels: Mapping[str, Sequence | DataFrame] | None = None,
) -> DataFrame:
    """Counts per level combination and their share within ``within``.

    ``where`` acts before counting and so decides the denominator.
    """
    chosen = df if where is None else df.filter(where)
    return share_of_total(crosstab(chosen, dims, levels), "n", within)


def mean_se(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, sample sd and standard error ``sd / sqrt(n)`` of the non-missing values."""
    stats = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    return stats.withColumn("se", F.try_divide(F.col("sd"), F.sqrt("n")))


def group_profile(df: DataFrame, by: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    """Mean per group, as population by feature; missing values are ignored."""
    return df.groupBy(*by).agg(F.avg(value).alias(name))


def box_stats(df: DataFrame, by: Sequence[str], value: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Quartiles, whisker ends at 1.5 IQR and the number of points beyond them."""
    counts = materialised(value_counts(df, by, value))
    quartiles = quantiles_of_counts(
        counts, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, block_rows=block_rows
    )
    x = F.col(value).cast("double")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (x >= F.col("q1") - spread) & (x <= F.col("q3") + spread)
    joined = join_groups(counts, quartiles.withColumnRenamed("n", "__total"), by)
    return joined.groupBy(*by).agg(
        F.max("__total").alias("n"),
        F.max("q1").alias("q1"),
        F.max("median").alias("median"),
        F.max("q3").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("n_outliers"),
    )


def binned_density(
    df: DataFrame, by: Sequence[str], value: str, bins: int, low: float | None = None, high: float | None = None
) -> DataFrame:
    """Histogram on equal bins: count, share of the group and density, empty bins included.

    Without ``low`` and ``high`` the range is that of the data; values outside a given range
    are left out, and the upper end belongs to the last bin. A group without a value in the
    range has no rows.
    """
    x = F.col(value).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo = ends.select("lo").scalar() if low is None else F.lit(float(low))
    hi = ends.select("hi").scalar() if high is None else F.lit(float(high))
    ranged = df.withColumns({"__lo": lo, "__hi": hi}).filter((x >= F.col("__lo")) & (x <= F.col("__hi")))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    at = F.coalesce(F.floor(F.try_divide(x - F.col("__lo"), width)), F.lit(0))
    # At most ``bins`` rows per group from here on.
    counted = (
        ranged.withColumns({"__bin": F.least(at, F.lit(bins - 1)).cast("bigint"), "__width": width})
        .groupBy(*by, "__bin")
        .agg(F.count(F.lit(1)).alias("__n"), F.max("__lo").alias("__lo"), F.max("__width").alias("__width"))
    )
    found = F.map_from_entries(F.collect_list(F.struct("__bin", "__n")))
    totals = (
        counted.groupBy(*by)
        .agg(F.sum("__n").alias("__total"), F.max("__lo").alias("__lo"), F.max("__width").alias("__width"), found.alias("__found"))
        .filter(F.col("__total") > 0)
        .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
        .withColumn("n", F.coalesce(F.try_element_at("__found", F.col("bin")), F.lit(0).cast("bigint")))
    )
    return totals.select(
        *by,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__width")).alias("bin_start"),
        "n",
        share("n", "__total").alias("share"),
        F.try_divide(share("n", "__total"), F.col("__width")).alias("density"),
    )


def mad_flag(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    threshold: float = 2.5,
    *,
    scale: float = 1.4826,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add median, scaled MAD and ``qc`` = Fail above ``median + threshold * MAD``.

    Both come from one histogram of the values: shifted by the median it is that of the deviations.
    ``df`` is read once for it and once for the result.
    """
    counts = materialised(value_counts(df, by, value))
    medians = materialised(quantiles_of_counts(counts, by, value, {"median": 0.5}, block_rows=block_rows).drop("n"))
    centred = join_groups(counts, medians, by).withColumn("__dev", F.abs(F.col(value) - F.col("median")))
    away = materialised(centred.groupBy(*by, "__dev").agg(F.sum("n").alias("n")))
    mads = quantiles_of_counts(away, by, "__dev", {"mad": 0.5}, block_rows=block_rows).drop("n")
    cuts = join_groups(medians, mads.withColumn("mad", F.lit(scale) * F.col("mad")), by)
    scaled = join_groups(df, cuts, by)
    limit = F.col("median") + F.lit(threshold) * F.col("mad")
    return scaled.withColumn(
        "qc", F.when(F.col(value).isNull(), None).when(F.col(value) > limit, "Fail").otherwise("Pass")
    )


def zscore_within(df: DataFrame, value: str, by: Sequence[str], name: str = "z_score") -> DataFrame:
    """z-score of each row against the rows of its group; NULL where the sd is 0 or undefined."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("group_sd"))
    return join_groups(df, stats, by).withColumn(
        name, F.try_divide(F.col(value) - F.col("group_mean"), F.col("group_sd"))
    )


def zscore_vs_global(
    df: DataFrame, population: str, feature: str, value: str, name: str = "z_score"
) -> DataFrame:
    """Population means against the mean and sd of all cells of the feature.

    The cells are read once: the global figures are rolled up from count, mean and spread of
    the populations.
    """
    pops = materialised(
        df.filter(F.col(value).isNotNull())
        .groupBy(population, feature)
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.avg(value).alias("pop_mean"),
            (F.var_pop(value) * F.count(F.lit(1))).alias("__m2"),
        )
    )
    means = pops.groupBy(feature).agg(
        F.sum("__n").alias("__total"),
        (F.sum(F.col("__n") * F.col("pop_mean")) / F.sum("__n")).alias("global_mean"),
    )
    centred = join_groups(pops, means, [feature])
    spread = F.col("__m2") + F.col("__n") * F.pow(F.col("pop_mean") - F.col("global_mean"), 2)
    sds = centred.groupBy(feature).agg(
        F.sqrt(F.try_divide(F.sum(spread), F.max("__total") - F.lit(1))).alias("global_sd")
    )
    scored = join_groups(centred, sds, [feature])
    return scored.select(
        population,
        feature,
        "pop_mean",
        "global_mean",
        "global_sd",
        F.try_divide(F.col("pop_mean") - F.col("global_mean"), F.col("global_sd")).alias(name),
    )
