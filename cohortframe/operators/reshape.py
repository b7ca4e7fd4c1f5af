"""Wide and long forms of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, name: str = "feature", value: str = "value"
) -> DataFrame:
    """Unpivot by column name; without ``columns`` everything but the ids.  NULL values stay."""
    chosen = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    return df.select(*ids, *[F.col(c).cast("double") for c in chosen]).unpivot(list(ids), chosen, name, value)


def to_wide(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    value: str,
    columns: Sequence[str],
    fill: float | None = None,
) -> DataFrame:
    """One column per listed value of ``name``; listing them saves a job that looks them up."""
    # A cell of the wide table has one source row, so max() only picks it.
    wide = df.groupBy(*ids).pivot(name, list(columns)).agg(F.max(value))
    return wide if fill is None else wide.fillna(fill, subset=list(columns))


def wide_features(
    cells: DataFrame,
    expr: DataFrame,
    genes: Sequence[str],
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
) -> DataFrame:
    """Add one column per gene to the cells: one filtered pivot and one join for all genes."""
    names = list(dict.fromkeys(genes))
    chosen = expr.filter(F.col(gene).isin(names))
    wide = chosen.groupBy(cell).pivot(gene, names).agg(F.sum(value))
    return cells.join(wide, cell, "left").fillna(0.0, subset=names)
