"""Row-wise rules, label repair, filters and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import member
from .keyed import join_groups, unique_by
from .scan import with_position


def classify(df: DataFrame, name: str, rules: Sequence[tuple[Column, str]], default: str | None = None) -> DataFrame:
    """Add ``name``: the value of the first rule that holds, else ``default``."""
    value = F.lit(default).cast("string")
    for condition, label in reversed(rules):
        value = F.when(condition, F.lit(label)).otherwise(value)
    return df.withColumn(name, value)


def relabel(df: DataFrame, rules: Sequence[tuple[Column, str, Mapping[str, str]]]) -> DataFrame:
    """Repair labels on a subset of rows.

    A rule is (rows it applies to, column, old -> new).  Every rule reads the original values,
    so a swap is simultaneous and conditions do not see each other's changes.  Values that a
    mapping does not list are kept.
    """
    changed: dict[str, Column] = {}
    for where, column, mapping in rules:
        current = F.col(column)
        repaired = current
        for old, new in reversed(list(mapping.items())):
            repaired = F.when(current == old, F.lit(new)).otherwise(repaired)
        changed[column] = F.when(where, repaired).otherwise(changed.get(column, current))
    return df.withColumns(changed)


def recode(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str) -> DataFrame:
    """Translate a column by a lookup table; values without an entry are kept."""
    table = unique_by(mapping.select(F.col(old).alias("__old"), F.col(new).alias("__new")), ["__old"], old)
    return (
        df.join(table, F.col(column) == F.col("__old"), "left")
        .withColumn(column, F.coalesce("__new", F.col(column)))
        .select(*df.columns)
    )


def with_level_order(df: DataFrame, column: str, levels: Sequence[str], ord_name: str = "ord") -> DataFrame:
    """Ordered categorical: add the level number (from 1); other values become NULL."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    rank = F.when(position > 0, position)
    return df.withColumns({ord_name: rank, column: F.when(rank.isNotNull(), F.col(column))})


def significant(
    df: DataFrame,
    p_col: str,
    alpha: float,
    effect_col: str | None = None,
    min_effect: float = 0.0,
    *,
    absolute: bool = False,
) -> DataFrame:
    """Rows with ``p < alpha`` and, if asked for, an effect above ``min_effect``."""
    kept = df.filter(F.col(p_col) < alpha)
    if effect_col is None:
        return kept
    effect = F.abs(effect_col) if absolute else F.col(effect_col)
    return kept.filter(effect > min_effect)


def volcano_class(
    df: DataFrame, effect: str, p_col: str, p_cut: float, fc_cut: float, name: str = "volcano"
) -> DataFrame:
    """Four classes by two cut-offs, and ``neg_log10_p`` for the vertical axis."""
    hit, strong = F.col(p_col) < p_cut, F.abs(effect) > fc_cut
    label = (
        F.when(F.col(p_col).isNull() | F.col(effect).isNull(), F.lit(None).cast("string"))
        .when(hit & strong, F.lit("p-value and log2 FC"))
        .when(hit, F.lit("p-value"))
        .when(strong, F.lit("Log2 FC"))
        .otherwise(F.lit("NS"))
    )
    return df.withColumns({name: label, "neg_log10_p": -F.log10(p_col)})


def feature_coverage(signatures: DataFrame, features: DataFrame, signature: str = "signature", gene: str = "gene"):
    """Per signature: genes asked for, genes present, whether complete, and the missing ones."""
    wanted = signatures.select(signature, gene).distinct()
    present = features.select(F.col(gene).alias("__present")).distinct()
    marked = wanted.join(present, F.col(gene) == F.col("__present"), "left")
    absent = F.when(F.col("__present").isNull(), F.col(gene))
    return marked.groupBy(signature).agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count("__present").alias("n_found"),
        (F.count(F.lit(1)) == F.count("__present")).alias("complete"),
        # As long as the signature itself, which is a short list of genes.
        F.array_sort(F.collect_list(absent)).alias("missing"),
    )


def present_features(signatures: DataFrame, features: DataFrame, gene: str = "gene") -> DataFrame:
    """The signature rows whose gene was detected; duplicates stay."""
    return signatures.join(features.select(gene).distinct(), gene, "left_semi")


def absent_features(signatures: DataFrame, features: DataFrame, gene: str = "gene") -> DataFrame:
    return signatures.join(features.select(gene).distinct(), gene, "left_anti")


def keep_members(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is in a short list or in the first column of a DataFrame."""
    if isinstance(values, DataFrame):
        keys = values.select(F.col(values.columns[0]).alias("__key"))
        return df.join(keys, F.col(column) == F.col("__key"), "left_semi")
    return df.filter(member(column, values))


def batch_groups(df: DataFrame, column: str, size: int) -> DataFrame:
    """The distinct values in name order, cut into batches of ``size`` numbered from 1."""
    numbered = with_position(df.select(column).filter(F.col(column).isNotNull()).distinct(), [], [column], "pos")
    return numbered.withColumn("batch", F.ceil(F.col("pos") / F.lit(size)).cast("bigint"))


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def concat_frames(frames: Sequence[DataFrame | None]) -> DataFrame:
    """Stack result frames; absent ones are skipped and absent columns filled with NULL."""
    kept = [f for f in frames if f is not None]
    if not kept:
        raise ValueError("nothing to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def order_by_levels(df: DataFrame, column: str, levels: Sequence[str], *then: str) -> DataFrame:
    """Sort by the order of categories, unknown categories last."""
    position = F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column)), F.lit(0))
    return df.orderBy(F.asc_nulls_last(position), *then)


def order_by_first_seen(df: DataFrame, column: str, other: DataFrame, row_idx: str) -> DataFrame:
    """Sort by the order in which the values of ``column`` first occur in ``other``.

    ``other`` shares the column name and numbers its rows by ``row_idx``, as ``df`` does.
    """
    seen = other.groupBy(column).agg(F.min(row_idx).alias("__seen"))
    return join_groups(df, seen, [column]).orderBy(F.asc_nulls_last("__seen"), row_idx).drop("__seen")
