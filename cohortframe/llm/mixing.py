"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.session import materialised, shuffle_partitions

#: Copies that the table of the distribution goes to beyond the mean, in standard deviations.
TAIL = 12


def uniform(seed: str, *parts: Column) -> Column:
    """A number from 0 to just below 1 that depends on the seed and the parts only."""
    named = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substr(F.md5(named), F.lit(1), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def source_sizes(docs: DataFrame, source: str = "source", size: Column | None = None) -> DataFrame:
    """``source, size`` with one row per source, a missing source being one of its own."""
    size = F.lit(1) if size is None else size
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))


def tempered(sizes: DataFrame, exponent: float = 0.5) -> DataFrame:
    """``source, weight``: weights proportional to a power of the size; 1 keeps the natural mix, 0 is uniform."""
    return sizes.select("source", F.pow("size", F.lit(exponent)).alias("weight"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """``source, rate``: how often each source must be repeated to have its share of ``total``.

    ``total`` is the size of the mix; by default that of all sources. Weights need not add up to 1;
    a source without a weight, with one that is not positive, or without a size has the rate 0.
    """
    known = sizes.join(weights.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "left")
    known = known.select("source", "size", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    sums = known.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    if not sums["w"] or not sums["s"]:
        return known.select("source", F.lit(0.0).alias("rate"))
    whole = sums["s"] if total is None else float(total)
    share = F.col("weight") / F.lit(float(sums["w"]))
    return known.select("source", F.when(F.col("size") > 0, share * F.lit(whole) / F.col("size")).otherwise(0.0).alias("rate"))


def poisson_steps(rates: DataFrame) -> DataFrame:
    """``source, steps``: the cumulative probabilities of 0, 1, 2 ... copies at each source's rate."""
    last = F.ceil(F.col("rate") + TAIL * F.sqrt("rate") + TAIL).cast("long")
    k = rates.select("source", "rate", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    by = Window.partitionBy("source", "rate").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    factorial = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(by)
    power = F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.ln("rate"))
    p = F.when(F.col("rate") > 0, F.exp(power - F.col("rate") - factorial)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    steps = k.withColumn("p", p).withColumn("below", F.sum("p").over(by))
    return steps.groupBy("source").agg(F.array_sort(F.collect_list("below")).alias("steps"))


def mix(docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: str = "mix", copy: str = "copy", order: str = "shuffle_key") -> DataFrame:
    """Each row repeated a Poisson number of times at its source's rate, in a global random order.

    The number is the inverse of the distribution function at a uniform number hashed from the seed
    and the key, so a rerun, a lost task or another partitioning repeats the same rows. Columns
    ``copy`` (from 0) and ``order`` are added, replacing ones with these names; ``order`` is uniform
    and puts the whole mix in one random order, by which each output file is sorted. Rows with one key in one source draw the same number; missing
    keys draw as one key. A source that ``rates`` lacks has the rate 0. An empty table gives
    an empty one.
    """
    # Written first: its size is known then, and a few rows per source are not joined by a shuffle.
    steps = materialised(poisson_steps(rates).withColumnsRenamed({"source": "__source", "steps": "__steps"}))
    docs = docs.drop(copy, order)
    drawn = docs.withColumn("__u", uniform(seed, F.col(key)))
    drawn = drawn.join(steps, F.col(source).eqNullSafe(F.col("__source")))
    number = F.size(F.filter("__steps", lambda s: s <= F.col("__u")))
    drawn = drawn.withColumn("__n", number).where("__n > 0")
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__source", "__steps", "__u", "__n")
    copies = copies.withColumn(order, uniform(seed + "-order", F.col(key), F.col(copy)))
    # Dealt out by the hash of a uniform number, then sorted by it: a random place for every copy.
    return copies.repartition(shuffle_partitions(docs.sparkSession), order).sortWithinPartitions(order)
