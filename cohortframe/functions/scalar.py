"""Column helpers whose NULL behaviour is fixed and stated."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def share(part: str | Column, total: str | Column) -> Column:
    """``part / total``; NULL when the total is zero."""
    return F.try_divide(_col(part).cast("double"), _col(total).cast("double"))


def member(column: str | Column, values: Iterable) -> Column:
    """Set membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(_col(column).isin(list(values)), F.lit(False))


def joined_key(*columns: str | Column, sep: str = " ", null_token: str = "NA") -> Column:
    """Composite key in which a missing part shows as ``null_token``."""
    return F.concat_ws(sep, *[F.coalesce(_col(c).cast("string"), F.lit(null_token)) for c in columns])


def sample_key(individual: str | Column, timepoint: str | Column, null_token: str | None = None) -> Column:
    """Patient name without underscores, ``_``, time point; NULL for a missing patient.

    A missing time point gives NULL too, unless ``null_token`` names its replacement.
    """
    when = _col(timepoint)
    if null_token is not None:
        when = F.coalesce(when, F.lit(null_token))
    return F.concat(F.regexp_replace(_col(individual), "_", ""), F.lit("_"), when)


def before_mark(column: str | Column, mark: str) -> Column:
    """Text before the first ``mark``; the whole text if there is none."""
    return F.substring_index(_col(column), mark, 1)


def without_suffix(column: str | Column, suffix: str) -> Column:
    """Every occurrence of the literal ``suffix`` removed, as a file name without extension."""
    return F.replace(_col(column), F.lit(suffix), F.lit(""))


def split_column(df: DataFrame, column: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Replace a text column by its pieces: surplus pieces are dropped, missing ones NULL."""
    pieces = F.split(F.col(column), f"\\Q{sep}\\E")
    return df.withColumns({name: F.get(pieces, F.lit(i)) for i, name in enumerate(into)}).drop(
        *([] if column in into else [column])
    )
