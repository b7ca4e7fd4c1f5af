"""Key joins, ordinal alignment and level completion."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .keyed import join_groups, unique_by
from .scan import BLOCK_ROWS, with_position

#: Combinations of levels that one row lists at a time.
GRID_PIECE = 4_096
#: Combinations that a task writes, and the tasks beyond which it writes more.
GRID_ROWS = 1_000_000
MAX_TASKS = 100_000


def attach(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Add the columns of ``right`` by key; a key with two rows there fails the job."""
    keys = [key] if isinstance(key, str) else list(key)
    return left.join(unique_by(right, keys), keys, "left")


def attach_by_ordinal(
    left: DataFrame, right: DataFrame, group: str, order: str = "row_idx", *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Give the n-th row of a group the columns of the n-th row of that group in ``right``.

    Both sides carry the ingest number ``order``, unique within a group. Only group and number are ranked and
    written; the other columns are joined by them. Fails if a group has a different number of
    rows on the two sides, or if one side lacks it.
    """
    here, there = (
        with_position(side.select(group, F.col(order).alias(name)), [group], [name], "__rn", block_rows=block_rows)
        for side, name in ((left, "__left"), (right, "__right"))
    )
    there = there.withColumnsRenamed({group: "__group", "__rn": "__rn_right"})
    same = here[group].eqNullSafe(there["__group"]) & (here["__rn"] == there["__rn_right"])
    # A group of unequal length leaves a number without partner on one side.
    aligned = F.col("__rn").isNotNull() & F.col("__rn_right").isNotNull()
    checked = F.when(aligned, F.lit(True)).otherwise(
        F.raise_error(
            F.concat(
                F.lit(f"row counts differ for {group} "),
                F.coalesce(F.col(group).cast("string"), F.col("__group").cast("string"), F.lit("NULL")),
            )
        )
    )
    # Written, so that a join cannot drop a number without partner before it is checked.
    pairs = materialised(here.join(there, same, "full").filter(checked).select("__group", "__left", "__right"))
    values = right.select(
        F.col(group).alias("__value_group"), F.col(order).alias("__value_order"), *[c for c in right.columns if c not in left.columns]
    )
    numbered = left.join(pairs, left[group].eqNullSafe(F.col("__group")) & left[order].eqNullSafe(F.col("__left")))
    found = F.col("__group").eqNullSafe(F.col("__value_group")) & F.col("__right").eqNullSafe(F.col("__value_order"))
    return numbered.join(values, found).drop("__group", "__left", "__right", "__value_group", "__value_order")


def map_ids(df: DataFrame, mapping: DataFrame, key: str, *, keep_unmapped: bool = False) -> DataFrame:
    """Translate identifiers; one that maps to several gives several rows.

    Without ``keep_unmapped`` the unmapped rows go; :func:`unmapped_ids` lists them.
    """
    return df.join(mapping.distinct(), key, "left" if keep_unmapped else "inner")


def unmapped_ids(df: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(mapping.select(key), key, "left_anti")


def add_sample_metadata(cells: DataFrame, metadata: DataFrame, key: str = "Sample_Name") -> DataFrame:
    """Sample annotations on every cell; a sample without metadata keeps its cells."""
    return attach(cells, metadata, key)


def join_features(
    cells: DataFrame,
    expr: DataFrame,
    features: Sequence[str] | DataFrame,
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    feature_name: str = "feature",
    value_name: str = "abundance",
    fill: float | None = 0.0,
) -> DataFrame:
    """One row per cell and chosen feature, with 0 where nothing is stored.

    The chosen expression values of a cell, at most one per feature, travel as a map.  The
    expression table is filtered before it is shuffled, and the rows per cell are produced by
    a generator after the join, not by a product of two tables.
    """
    if isinstance(features, DataFrame):
        wanted = features.select(F.col(features.columns[0]).alias("__f")).distinct()
        chosen = expr.join(wanted, F.col(gene) == F.col("__f"), "left_semi")
        cells = cells.withColumn("__list", wanted.agg(F.array_sort(F.collect_set("__f")).alias("l")).scalar())
    else:
        names = list(dict.fromkeys(features))
        chosen = expr.filter(F.col(gene).isin(names))
        cells = cells.withColumn("__list", F.array(*[F.lit(n) for n in names]))
    per_cell = (
        chosen.groupBy(cell, gene)
        .agg(F.sum(value).alias("__v"))
        .groupBy(cell)
        .agg(F.map_from_entries(F.collect_list(F.struct(gene, "__v"))).alias("__values"))
    )
    long = cells.join(per_cell, cell, "left").withColumn(feature_name, F.explode("__list"))
    found = F.try_element_at("__values", F.col(feature_name))
    filled = found if fill is None else F.coalesce(found, F.lit(fill).cast("double"))
    return long.withColumn(value_name, filled).drop("__list", "__values")


def group_pairs(df: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """All unordered pairs of the distinct groups: ``group_1 < group_2`` in name order.

    The pairs are the wanted result; each group meets its partners through equal numbers,
    so the work is spread over ``(by, number)`` instead of one task per product.
    """
    names = df.select(*by, group).filter(F.col(group).isNotNull()).distinct()
    numbered = with_position(names, list(by), [group], "__i")
    size = numbered.groupBy(*by).agg(F.max("__i").alias("__k"))
    if by:
        first = join_groups(numbered, size, list(by))
    else:
        first = numbered.withColumn("__k", size.select("__k").scalar())
    first = (
        first.filter(F.col("__i") < F.col("__k"))
        .withColumn("__j", F.explode(F.sequence(F.col("__i") + 1, F.col("__k"))))
        .withColumnRenamed(group, "group_1")
        .drop("__i", "__k")
    )
    second = numbered.withColumnsRenamed({group: "group_2", "__i": "__j"})
    return join_groups(first, second, [*by, "__j"], "inner").select(*by, "group_1", "group_2")


def check_aligned(
    left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, tol: float = 1.5e-8
) -> DataFrame:
    """One row: keys on one side only, mean relative difference, and whether both agree.

    Both sums run over the elements that differ: equal ones do not dilute the difference.
    """
    a = left.select(F.col(key).alias("__a"), F.col(left_value).cast("double").alias("__x"))
    b = right.select(F.col(key).alias("__b"), F.col(right_value).cast("double").alias("__y"))
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    one_sided = F.col("__a").isNull() | F.col("__b").isNull()
    one_null = ~one_sided & (F.col("__x").isNull() != F.col("__y").isNull())
    unequal = ~one_sided & (F.col("__x") != F.col("__y"))
    summary = both.agg(
        F.count_if(one_sided).alias("one_sided_keys"),
        F.count_if(one_null).alias("one_sided_nulls"),
        F.sum(F.when(unequal, F.abs(F.col("__x") - F.col("__y")))).alias("__diff"),
        F.sum(F.when(unequal, F.abs("__x"))).alias("__size"),
    )
    diff = F.coalesce("__diff", F.lit(0.0))
    relative = F.coalesce(F.try_divide(diff, F.col("__size")), diff)
    agree = (F.col("one_sided_keys") == 0) & (F.col("one_sided_nulls") == 0) & (relative < tol)
    return summary.select("one_sided_keys", "one_sided_nulls", relative.alias("mean_rel_diff"), agree.alias("aligned"))


def complete_levels(
    counts: DataFrame,
    dims: Sequence[str],
    values: Sequence[str],
    levels: Mapping[str, Sequence | DataFrame] | None = None,
    fill: float | int = 0,
) -> DataFrame:
    """Add the level combinations that do not occur, with ``fill`` in ``values``.

    Levels are those found in ``counts``; ``levels`` declares others for a dimension, in which
    case rows with an undeclared level are dropped, as a factor would drop them. Levels stay
    tables, however many there are (see :func:`level_grid`).
    """
    declared = dict(levels or {})
    # Read for each dimension and at the end; the counts are small beside the rows they stand for.
    counts = materialised(counts.dropna(subset=list(dims)).select(*dims, *values))
    found = {}
    for dim in dims:
        given = declared.get(dim)
        if given is None:
            names = counts.filter(F.col(values[0]).isNotNull()).select(dim)
        elif isinstance(given, DataFrame):
            names = given.select(F.col(given.columns[0]).alias(dim))
        else:
            listed = F.array(*[F.lit(v) for v in given]).cast(f"array<{counts.schema[dim].dataType.simpleString()}>")
            names = counts.sparkSession.range(1).select(F.explode(listed).alias(dim))
        found[dim] = names.dropna().distinct()
    full = level_grid(found).join(counts, list(dims), "left")
    return full.withColumns({v: F.coalesce(F.col(v), F.lit(fill).cast(counts.schema[v].dataType)) for v in values})


def level_grid(levels: Mapping[str, DataFrame], *, piece: int = GRID_PIECE) -> DataFrame:
    """All combinations of the levels: a column for each dimension, whose table holds distinct names.

    The largest dimension stays as rows in its partitions. The combinations of the others are the numbers
    from 0 to the product of their sizes; each row lists them in pieces of ``piece``, a number is decoded
    by mixed radix, and the decoded places are joined with the numbered names. No row holds
    all names or all combinations. A dimension without levels gives an empty grid.
    """
    tables = {dim: materialised(names) for dim, names in levels.items()}
    sizes = {dim: names.count() for dim, names in tables.items()}
    base = max(sizes, key=lambda dim: sizes[dim])
    others = [dim for dim in tables if dim != base]
    total = math.prod(sizes[dim] for dim in others)
    if not total or not sizes[base]:
        return tables[base].select(*[F.col(base) if dim == base else F.lit(None).cast(tables[dim].schema[dim].dataType).alias(dim) for dim in tables]).filter(F.lit(False))
    # A number of tasks that is asked for stays: names that fit one task make a grid that does not.
    tasks = min(-(-total * sizes[base] // GRID_ROWS), MAX_TASKS)
    grid = tables[base].repartition(tasks, base) if others else tables[base]
    if others:
        grid = grid.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"), F.lit(piece).cast("long"))))
        last = F.least(F.col("__from") + (piece - 1), F.lit(total - 1).cast("long"))
        grid = grid.withColumn("__at", F.explode(F.sequence(F.col("__from"), last))).drop("__from")
    stride = 1
    for dim in others:
        named = with_position(tables[dim], [], [dim], "__place")
        place = F.expr(f"__at div {stride}L") % F.lit(sizes[dim]).cast("long") + 1
        grid = grid.withColumn("__place", place).join(named, "__place").drop("__place")
        stride *= sizes[dim]
    return grid.select(*tables)


def terms_with_symbols(
    hits: DataFrame, mapping: DataFrame, by: Sequence[str], gene_id: str, symbol: str, name: str = "symbols"
) -> DataFrame:
    """Gene ids of each term as one text of readable symbols, in name order.

    A term holds at most as many genes as its size limit in the enrichment allows.
    """
    readable = hits.join(mapping.select(gene_id, symbol).distinct(), gene_id, "inner")
    return readable.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(symbol)), "/").alias(name))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """Fail the job on the first row that breaks ``condition``."""
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message))))
