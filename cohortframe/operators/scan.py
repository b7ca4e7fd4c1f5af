"""Running totals, ranks and quantiles inside groups of any size.

A plain ``Window.partitionBy(group).orderBy(value)`` sends a whole group to one task.  Here the
input, usually a histogram, is materialised once and its largest group measured.  Up to
``block_rows`` rows the plain window is used.  Beyond that every group is cut into value
ranges, each range is accumulated alone, and the totals of the ranges before it are added.
The cut points are values picked by their hash, so they depend on the data only, and a task
that runs again after the loss of an executor finds the same ranges. Their number follows from
the size of the group; more are picked than needed and evenly thinned, which evens the ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialised
from .keyed import join_groups

BLOCK_ROWS = 4_000_000
#: Values picked for each cut that is kept.
PICKS = 8

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}
_JOIN = {
    "sum": lambda before, here: F.coalesce(before + here, here),
    "max": lambda before, here: F.greatest(before, here),
    "min": lambda before, here: F.least(before, here),
}


@dataclass(frozen=True)
class Ordered:
    """Rows with an ``__order`` column; ``split`` says that they carry ``__block`` numbers."""

    df: DataFrame
    by: tuple[str, ...]
    split: bool

    def having(self, df: DataFrame) -> Ordered:
        """The same order on a table derived from this one."""
        return Ordered(df, self.by, self.split)

    def plain(self) -> DataFrame:
        return self.df.drop("__order", "__block")


def ordered(
    df: DataFrame,
    by: Sequence[str],
    order: Column,
    *,
    block_rows: int = BLOCK_ROWS,
    stored: bool = False,
) -> Ordered:
    """Prepare running values of ``df`` in ascending ``order`` within ``by``."""
    by = list(by)
    keyed = (df if stored else materialised(df)).withColumn("__order", order)
    largest = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= block_rows:
        return Ordered(keyed, tuple(by), False)
    identity = [*by, "__order"]
    cuts = PICKS * -(-2 * largest // block_rows)
    picks = keyed.groupBy(*by, F.pmod(F.xxhash64(F.lit(1), *identity), F.lit(cuts)).alias("__class")).agg(
        F.min_by("__order", F.xxhash64(*identity)).alias("__pick"),
        F.count(F.lit(1)).alias("__rows"),
    )
    # At most ``cuts`` values per group, one for each half of ``block_rows`` after thinning, so that uneven
    # ranges stay below ``block_rows``; groups that need no cut get no row.
    chosen = [F.sum("__rows").alias("__rows"), F.array_sort(F.collect_list("__pick")).alias("__picks")]
    wanted = F.ceil(2 * F.col("__rows") / block_rows)
    stride = F.greatest(F.lit(1), F.floor(F.size("__picks") / wanted)).cast("int")
    thinned = F.filter("__picks", lambda _, i: (i + 1) % F.col("__stride") == 0).alias("__cuts")
    large = picks.groupBy(*by).agg(*chosen).filter(F.col("__rows") > block_rows)
    large = large.withColumn("__stride", stride).select(*by, thinned)
    if by:
        keyed = join_groups(keyed, large, by)
    else:
        keyed = keyed.withColumn("__cuts", large.select("__cuts").scalar())
    below = F.size(F.filter("__cuts", lambda cut: cut <= F.col("__order")))
    return Ordered(
        keyed.withColumn("__block", F.coalesce(below, F.lit(0))).drop("__cuts"), tuple(by), True
    )


def running(
    rows: Ordered, measures: Mapping[str, tuple[str, Column]], *, descending: bool = False
) -> Ordered:
    """Add inclusive running values; rows that tie share the value.

    ``measures`` maps an output name to (``sum`` | ``max`` | ``min``, column).
    """
    direction = F.desc if descending else F.asc
    if not rows.split:
        whole = Window.partitionBy(*rows.by).orderBy(direction("__order"))
        return rows.having(
            rows.df.withColumns({name: _FOLD[fn](col).over(whole) for name, (fn, col) in measures.items()})
        )
    block = [*rows.by, "__block"]
    local = Window.partitionBy(*block).orderBy(direction("__order"))
    totals = rows.df.groupBy(*block).agg(
        *[_FOLD[fn](col).alias(f"__t_{name}") for name, (fn, col) in measures.items()]
    )
    # One row per block.
    before = Window.partitionBy(*rows.by).orderBy(direction("__block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *block, *[_FOLD[fn](f"__t_{name}").over(before).alias(f"__b_{name}") for name, (fn, _) in measures.items()]
    )
    inner = rows.df.withColumns({name: _FOLD[fn](col).over(local) for name, (fn, col) in measures.items()})
    joined = join_groups(inner, offsets, block).withColumns(
        {name: _JOIN[fn](F.col(f"__b_{name}"), F.col(name)) for name, (fn, _) in measures.items()}
    )
    return rows.having(joined.drop(*[f"__b_{name}" for name in measures]))


def accumulate(
    df: DataFrame,
    by: Sequence[str],
    order: Column,
    measures: Mapping[str, tuple[str, Column]],
    *,
    block_rows: int = BLOCK_ROWS,
    stored: bool = False,
) -> DataFrame:
    """:func:`ordered` and one :func:`running`."""
    return running(ordered(df, by, order, block_rows=block_rows, stored=stored), measures).plain()


def with_position(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rn", *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Number the rows of a group from 1; ``order`` must identify a row within its group."""
    return accumulate(df, by, F.struct(*order), {name: ("sum", F.lit(1).cast("bigint"))}, block_rows=block_rows)


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Histogram of the exact values: ``by``, ``value``, ``n``; NULL values are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, name: str = "avg_rank", *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Ascending rank of each distinct value, ties sharing the mean rank: ``by, value, n, name``."""
    counted = accumulate(
        value_counts(df, by, value), by, F.col(value), {"__upto": ("sum", F.col("n"))}, block_rows=block_rows
    )
    rank = F.col("__upto") - (F.col("n") - 1) / F.lit(2.0)
    return counted.withColumn(name, rank).drop("__upto")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Interpolated (type 7) quantiles per group, from value counts instead of buffered rows."""
    return quantiles_of_counts(materialised(value_counts(df, by, value)), by, value, probs, block_rows=block_rows)


def quantiles_of_counts(
    counts: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Quantiles from a materialised histogram ``by, value, n``."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("__total"))
    upto = accumulate(
        counts, by, F.col(value), {"__upto": ("sum", F.col("n"))}, block_rows=block_rows, stored=True
    )
    ranked = join_groups(upto, totals, by)
    parts, outputs = [], []
    x = F.col(value).cast("double")
    for name, prob in probs.items():
        at = (F.col("__total") - 1) * F.lit(float(prob))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("__upto") - F.col("n") <= index) & (index < F.col("__upto"))
            parts.append(F.max(F.when(hit, x)).alias(f"__{side}_{name}"))
        parts.append(F.max(at - F.floor(at)).alias(f"__w_{name}"))
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        outputs.append((low + (high - low) * F.col(f"__w_{name}")).alias(name))
    return ranked.groupBy(*by).agg(F.max("__total").alias("n"), *parts).select(*by, "n", *outputs)
