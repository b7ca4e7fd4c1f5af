"""Joins on group keys that may be NULL, and lazy checks of key uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group table back to rows; NULL is a group like any other.

    No broadcast hint: the optimizer broadcasts ``right`` when its size, estimated or
    measured by adaptive execution, is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    if not keys:
        raise ValueError("join_groups needs at least one key")
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    matches = [left[k].eqNullSafe(renamed[f"__right_{k}"]) for k in keys]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def unique_by(df: DataFrame, keys: Sequence[str], what: str = "key") -> DataFrame:
    """``df`` unchanged if ``keys`` identify its rows; the running job fails if they do not.

    The aggregate is hash-partitioned on ``keys``, so a join on the same keys reuses it.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.min(F.struct(*rest) if rest else F.lit(1)).alias("__row"), F.count(F.lit(1)).alias("__n")
    )
    guard = F.when(F.col("__n") == 1, F.col("__row")).otherwise(
        F.raise_error(F.concat(F.lit(f"more than one row for {what}: "), F.to_json(F.struct(*keys))))
    )
    checked = grouped.withColumn("__row", guard)
    if not rest:
        return checked.filter(F.col("__row").isNotNull()).select(*keys)
    return checked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def constant_within(column: str | Column, name: str) -> Column:
    """Aggregate: the one value of a column that depends on the group key.

    NULLs are skipped; two different values in a group fail the job.
    """
    col = F.col(column) if isinstance(column, str) else column
    low, high = F.min(col), F.max(col)
    checked = F.when(low.eqNullSafe(high), low).otherwise(
        F.raise_error(F.lit(f"{name} is not constant within its group"))
    )
    return checked.alias(name)
