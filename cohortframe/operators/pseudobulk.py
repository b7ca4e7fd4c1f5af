"""Sums of raw counts per sample, and the filters and scales that follow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialised
from .joins import complete_levels
from .keyed import join_groups
from .scan import quantiles_of_counts
from .trend import Knots, find_knots, local_lines

# The published defaults of the expression filter.
MIN_COUNT = 10.0
MIN_TOTAL_COUNT = 15.0
LARGE_GROUP = 10.0
MIN_PROPORTION = 0.7
# The published trimming shares of the M-value normalisation.
TRIM_RATIO = 0.3
TRIM_ABUNDANCE = 0.05


def pseudobulk(
    expr: DataFrame,
    cells: DataFrame,
    by: Sequence[str],
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """Summed counts per sample and gene, with ``n_cells`` of the sample.

    Counts add up before the shuffle, so a sample or gene with very many rows costs no more
    than any other.  ``n_cells`` comes from the cells, including those without any count.
    """
    by = list(by)
    sums = expr.join(cells.select(cell, *by), cell).groupBy(*by, gene).agg(F.sum(count).alias(count))
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"))
    return join_groups(sums, sizes, by)


def library_sizes(pb: DataFrame, sample: str = "sample", count: str = "count") -> DataFrame:
    return pb.groupBy(sample).agg(F.sum(count).cast("double").alias("lib_size"))


def filter_by_expr(
    pb: DataFrame,
    samples: DataFrame | None = None,
    group: str | None = None,
    *,
    sample: str = "sample",
    gene: str = "gene",
    count: str = "count",
    min_count: float = MIN_COUNT,
    min_total_count: float = MIN_TOTAL_COUNT,
    large_n: float = LARGE_GROUP,
    min_prop: float = MIN_PROPORTION,
) -> DataFrame:
    """Rows of the genes with enough counts in enough samples.

    A gene needs ``min_count`` at the median library size, as counts per million, in as many
    samples as the smallest group has (fewer for groups above ``large_n``), and
    ``min_total_count`` in all.  Library sizes must be taken anew from the result.
    """
    pb = materialised(pb)  # read for the libraries, their median, the counts and the result
    libs = materialised(library_sizes(pb, sample, count))
    if group is None:
        sizes = libs.agg(F.count(F.lit(1)).cast("double").alias("m"))
    else:
        sizes = (
            samples.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("c")).agg(F.min("c").alias("m"))
        )
    smallest = F.when(F.col("m") > large_n, large_n + (F.col("m") - large_n) * min_prop).otherwise(F.col("m"))
    # One row per sample: the median runs over tens of values.
    median = libs.agg(F.median("lib_size").alias("v"))
    cutoff = F.lit(min_count * 1e6) / F.col("__median")
    scaled = join_groups(pb, libs, [sample]).withColumn("__median", median.scalar())
    passed = F.count_if(F.col(count) / F.col("lib_size") * 1e6 >= cutoff)
    kept = (
        scaled.groupBy(gene)
        .agg(passed.alias("__samples"), F.sum(count).alias("__total"))
        .withColumn("__needed", sizes.select(smallest.alias("s")).scalar())
        .filter((F.col("__samples") >= F.col("__needed") - 1e-14) & (F.col("__total") >= min_total_count - 1e-14))
    )
    return pb.join(kept.select(gene), gene, "left_semi")


def tmm_factors(
    pb: DataFrame,
    *,
    sample: str = "sample",
    gene: str = "gene",
    count: str = "count",
    trim_ratio: float = TRIM_RATIO,
    trim_abundance: float = TRIM_ABUNDANCE,
) -> DataFrame:
    """Library size and normalisation factor per sample by trimmed mean of M-values.

    The reference is the sample whose upper quartile, per library size, is nearest to the
    mean of all.  Ranks run over the genes of one sample.
    """
    stored = materialised(pb.filter(F.col(count) > 0).groupBy(sample, gene).agg(F.sum(count).cast("double").alias("__y")))
    libs = stored.groupBy(sample).agg(F.sum("__y").alias("lib_size"), F.sum(F.sqrt("__y")).alias("__root"))
    n_genes = stored.agg(F.countDistinct(gene).alias("g"))
    zeros = (
        stored.groupBy(sample)
        .agg(F.count(F.lit(1)).alias("k"))
        .withColumn("__g", n_genes.scalar())
        .select(sample, F.lit(0.0).alias("__y"), (F.col("__g") - F.col("k")).alias("n"))
        .filter(F.col("n") > 0)
    )
    counts = materialised(stored.groupBy(sample, "__y").agg(F.count(F.lit(1)).alias("n")).unionByName(zeros))
    quartiles = quantiles_of_counts(counts, [sample], "__y", {"q": 0.75}).select(sample, "q")
    scaled = materialised(libs.join(quartiles, sample).withColumn("__f", F.col("q") / F.col("lib_size")))
    centre = scaled.agg(F.avg("__f").alias("m"), F.median("__f").alias("d"))
    nearest = F.min_by(sample, F.struct(F.abs(F.col("__f") - F.col("m")), F.col(sample)))
    fullest = F.min_by(sample, F.struct(-F.col("__root"), F.col(sample)))
    chosen = (
        scaled.withColumns({"m": centre.select("m").scalar(), "d": centre.select("d").scalar()})
        .agg(F.when(F.max("d") < 1e-20, fullest).otherwise(nearest).alias("r"))
        .scalar()
    )
    sized = stored.join(scaled.select(sample, "lib_size"), sample)
    base = (
        sized.withColumn("__r", chosen)
        .filter(F.col(sample) == F.col("__r"))
        .select(gene, F.col("__y").alias("__y0"), F.col("lib_size").alias("__n0"))
    )
    y, n, y0, n0 = (F.col(c) for c in ("__y", "lib_size", "__y0", "__n0"))
    both = sized.join(base, gene).select(
        sample,
        F.log2((y / n) / (y0 / n0)).alias("__m"),
        ((F.log2(y / n) + F.log2(y0 / n0)) / 2.0).alias("__a"),
        ((n - y) / n / y + (n0 - y0) / n0 / y0).alias("__v"),
    )

    def mean_rank(column):
        # The default frame ends with the last tie, so rank and count enclose the ties.
        order = Window.partitionBy(sample).orderBy(column)
        return (F.rank().over(order) + F.count(F.lit(1)).over(order)) / 2.0

    ranked = both.withColumns(
        {"__rm": mean_rank("__m"), "__ra": mean_rank("__a"), "__k": F.count(F.lit(1)).over(Window.partitionBy(sample))}
    )

    def within(rank, trim):
        low = F.floor(F.col("__k") * F.lit(trim)) + 1
        return F.col(rank).between(low, F.col("__k") + 1 - low)

    kept = within("__rm", trim_ratio) & within("__ra", trim_abundance)
    weight = F.when(kept, 1.0 / F.col("__v"))
    factors = ranked.groupBy(sample).agg(
        F.try_divide(F.sum(weight * F.col("__m")), F.sum(weight)).alias("__f"), F.max(F.abs("__m")).alias("__max")
    )
    raw = F.when(F.col("__max") < 1e-6, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), F.coalesce("__f", F.lit(0.0))))
    raw_factors = materialised(
        join_groups(scaled.select(sample, "lib_size"), factors, [sample]).select(
            sample, "lib_size", F.coalesce(raw, F.lit(1.0)).alias("__raw")
        )
    )
    level = raw_factors.agg(F.exp(F.avg(F.log("__raw"))).alias("g")).scalar()
    return raw_factors.withColumn("__level", level).select(
        sample, "lib_size", (F.col("__raw") / F.col("__level")).alias("norm_factor")
    )


def log_cpm(
    pb: DataFrame,
    factors: DataFrame,
    *,
    prior: float = 2.0,
    sample: str = "sample",
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """log2 counts per million of every kept gene in every sample, zeros included.

    ``factors`` is the result of :func:`tmm_factors`, or library sizes with factor 1.  The
    prior count grows with the library.
    """
    full = complete_levels(pb.select(sample, gene, count), [gene, sample], [count])
    effective = factors.select(sample, (F.col("lib_size") * F.col("norm_factor")).alias("__lib"))
    mean = effective.agg(F.avg("__lib").alias("m")).scalar()
    sized = effective.withColumn("__mean", mean).withColumn("__prior", F.lit(prior) * F.col("__lib") / F.col("__mean"))
    value = F.log2((F.col(count) + F.col("__prior")) / (F.col("__lib") + 2.0 * F.col("__prior")) * 1e6)
    return full.join(sized, sample).select(sample, gene, value.alias("log_cpm"))


def gene_variances(
    expr: DataFrame, n_cells: int | Column, *, gene: str = "gene", value: str = "logcount"
) -> DataFrame:
    """Mean and variance per gene over all cells; ``n_cells`` brings in the zeros."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    stored = expr.groupBy(gene).agg(
        F.count(F.lit(1)).alias("k"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(F.lit(1))).alias("s")
    )
    k, m = F.col("k"), F.col("m")
    counted = stored.withColumn("__n", n)
    total = F.col("__n")
    return counted.select(
        gene,
        (m * k / total).alias("mean"),
        ((F.col("s") + m * m * k * (total - k) / total) / (total - 1)).alias("variance"),
    )


def top_variable(
    expr: DataFrame, cells: DataFrame, k: int, *, gene: str = "gene", value: str = "logcount"
) -> DataFrame:
    """The ``k`` genes of largest variance, ties in name order."""
    n = cells.agg(F.count(F.lit(1)).alias("n")).scalar()
    return gene_variances(expr, n, gene=gene, value=value).orderBy(F.desc("variance"), gene).limit(k)


def variance_residuals(variances: DataFrame, *, gene: str = "gene", bins: int = 20) -> DataFrame:
    """Log variance minus its average among genes of like mean, on equal bins of the log mean.

    A binned trend, simpler than a fitted curve; it ranks genes, it does not test them.
    """
    positive = variances.filter((F.col("mean") > 0) & (F.col("variance") > 0))
    logs = positive.withColumns({"__x": F.log("mean"), "__y": F.log("variance")})
    ends = logs.agg(F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    placed = logs.withColumns({"__lo": ends.select("lo").scalar(), "__hi": ends.select("hi").scalar()})
    at = F.floor(F.try_divide(F.col("__x") - F.col("__lo"), (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))))
    binned = placed.withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)))
    trend = binned.groupBy("bin").agg(F.avg("__y").alias("__trend"))
    return join_groups(binned, trend, ["bin"]).select(
        gene, "mean", "variance", "bin", (F.col("__y") - F.col("__trend")).alias("residual")
    )


def trended_residuals(variances: DataFrame, *, gene: str = "gene", knots: Knots | None = None) -> DataFrame:
    """Log variance minus its trend: lines fitted locally along the log mean, see :mod:`.trend`.

    ``gene, mean, variance, trend, residual`` of the genes with a positive mean and variance; ``trend`` is that of the
    log variance. ``knots`` are found from the data unless given.
    """
    positive = variances.filter((F.col("mean") > 0) & (F.col("variance") > 0)).select(gene, "mean", "variance")
    logs = materialised(positive.withColumns({"x": F.log("mean"), "y": F.log("variance")}))
    knots = find_knots(logs, "x") if knots is None else knots
    middle = local_lines(logs, "x", "y", knots)[:, 0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["trend"] = knots.between(frame["x"].to_numpy(), middle)
            frame["residual"] = frame["y"] - frame["trend"]
            yield frame[[gene, "mean", "variance", "trend", "residual"]]

    id_type = logs.schema[gene].dataType.simpleString()
    return logs.mapInPandas(run, f"{gene} {id_type}, mean DOUBLE, variance DOUBLE, trend DOUBLE, residual DOUBLE")


def top_by_residual(variances: DataFrame, k: int, *, gene: str = "gene") -> DataFrame:
    """The ``k`` genes that vary most beyond the trend, ties in name order."""
    return trended_residuals(variances, gene=gene).orderBy(F.desc("residual"), gene).limit(k)
