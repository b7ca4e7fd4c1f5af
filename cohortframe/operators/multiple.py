"""Adjustment of p-values for multiple testing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .keyed import join_groups
from .scan import BLOCK_ROWS, ordered, running


def adjust_p(
    df: DataFrame,
    p_col: str,
    family: Sequence[str],
    method: str,
    *,
    adjusted: str = "adj_p_value",
    method_name: str | None = "method",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the ``holm`` or ``BH`` adjusted p-value within each family.

    Missing p-values stay missing and do not count.  Ties need no tie-break: Holm takes the
    first rank of a tie and BH the last, which is what the running maximum and minimum leave.
    Equal p-values are counted before they are put in order, and the result is joined back to
    the tests, so that the many ties at 1 never meet in one task.
    """
    p = F.col(p_col)
    tests = materialised(df)
    # At most one row per distinct value.
    counts = tests.groupBy(*family, p_col).agg(F.count(F.lit(1)).alias("__n"))
    known = F.when(p.isNotNull(), F.col("__n"))
    rows = ordered(counts, family, p, block_rows=block_rows)
    if method == "holm":
        # Tests from here on, counted from the largest p down: n - rank + 1.
        counted = running(rows, {"__left": ("sum", known)}, descending=True)
        stepped = running(counted, {"__adj": ("max", F.col("__left") * p)})
    elif method == "BH":
        counted = running(rows, {"__rank": ("sum", known)})
        if family:
            sized = join_groups(counted.df, rows.df.groupBy(*family).agg(F.sum(known).alias("__tests")), family)
        else:
            sized = counted.df.withColumn("__tests", rows.df.agg(F.sum(known).alias("t")).scalar())
        scaled = sized.withColumn("__scaled", p * F.col("__tests") / F.nullif("__rank", F.lit(0)))
        stepped = running(counted.having(scaled), {"__adj": ("min", F.col("__scaled"))}, descending=True)
    else:
        raise ValueError("method must be 'holm' or 'BH'")
    result = F.when(p.isNotNull(), F.least(F.lit(1.0), F.col("__adj")))
    found = stepped.plain().select(*family, p_col, result.alias(adjusted))
    joined = join_groups(tests.drop(adjusted), found, [*family, p_col])
    return joined.withColumn(method_name, F.lit(method)) if method_name else joined
