"""Reading and writing the cohort tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import with_position
from ..session import materialised


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a header row and a declared schema; a header that differs fails the read."""
    return (
        spark.read.schema(schema)
        .options(header=True, enforceSchema=False, nullValue="NA", mode="FAILFAST", **options)
        .csv(path)
    )


def read_csv_in_order(
    spark: SparkSession, path: str, schema: T.StructType | str, order: str = "row_idx", **options
) -> DataFrame:
    """:func:`read_csv` with the number of each row, from 1, in the order of the files.

    Files count in the order of their paths. The number is given once and written, so that it
    stays the same however often the table is read.
    """
    rows = read_csv(spark, path, schema, **options)
    place = {
        "__file": F.col("_metadata.file_path"),
        "__start": F.col("_metadata.file_block_start"),
        "__row": F.monotonically_increasing_id(),  # grows along a block of a file
    }
    placed = with_position(rows.select("*", *[c.alias(n) for n, c in place.items()]), [], list(place), order)
    return materialised(placed.drop(*place))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header.  A row name is an ordinary column here, so there is no index."""
    df.write.mode(mode).option("header", True).csv(path)


def write_csv_per_key(
    df: DataFrame, path: str, key: str, *, parts: int | None = None, mode: str = "errorifexists"
) -> None:
    """One folder ``key=value`` of CSV files per value; NULL goes to the default partition.

    Values with many rows are split over tasks and files by their size; ``parts`` fixes the
    number of files per value instead.
    """
    if parts is None:
        spread = df.hint("rebalance", F.col(key))
    elif parts > 1:
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(parts))
        spread = df.repartition(F.col(key), salt)
    else:
        spread = df.repartition(key)
    spread.write.mode(mode).option("header", True).partitionBy(key).csv(path)


def load_dataset(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a saved cohort: one Parquet folder each."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_dataset(
    tables: Mapping[str, DataFrame],
    folder: str,
    *,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write every table as Parquet; also the way to keep an intermediate result."""
    chosen = dict(partition_by or {})
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if name in chosen:
            writer = writer.partitionBy(*chosen[name])
        writer.parquet(f"{folder}/{name}")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str, mode: str = "errorifexists") -> None:
    """Store a table bucketed and sorted by ``key``.

    Cells and expression values bucketed alike on ``cell_id`` join and aggregate per cell
    without a shuffle.
    """
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring names the table does not have."""
    return df.drop(*names)
