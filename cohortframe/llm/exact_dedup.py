"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortframe.session import materialised, new_folder, shuffle_partitions

from .common import lookup, text_of

#: Keys a bucket holds before it is split.
CAPACITY = 100_000
#: Doublings of the directory for each reading of the keys.
STEP = 16
#: Rows of one key that are never dealt to several owners, and the share of all rows that may be.
HOT_ROWS = 1_000
HOT_SHARE = 10_000


def _prefix(key: Column | str, depth: int | Column) -> Column:
    """The first ``depth`` bits of a 64-bit key."""
    bits = F.lit(depth) if isinstance(depth, int) else depth
    key = F.col(key) if isinstance(key, str) else key
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, (64 - bits).cast("int")))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``depth, bucket``: the leaves of an extendible-hash directory over the distinct ``key`` values.

    It starts as one bucket of depth 0. Each round doubles the directory: buckets with more than
    ``capacity`` keys are split by their next bit, the others stay, until none is overfull. Copies
    share a key and cannot be split, so only distinct keys count. Keys are read once for ``STEP``
    doublings: they are counted by that many more bits, and only those in buckets that are still
    overfull afterwards are counted again.
    """
    spark = keys.sparkSession
    keys = keys.select("key").distinct()
    open_ = spark.range(1).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"))
    leaves = open_.where("false")
    depth = 0
    while True:
        if depth % STEP == 0:
            if depth:
                keys = keys.join(open_.select("bucket"), _prefix("key", depth - 1) == F.shiftright("bucket", 1), "left_semi")
            keys = materialised(keys)
            fine = min(depth + STEP, 64)
            held = materialised(keys.groupBy(_prefix("key", fine).alias("cell")).agg(F.count("*").alias("n")))
        at = held.groupBy(F.call_function("shiftrightunsigned", F.col("cell"), F.lit(fine - depth)).alias("bucket") if depth else F.lit(0).cast("long").alias("bucket"))
        counted = materialised(open_.join(at.agg(F.sum("n").alias("count")), "bucket", "left"))
        full = F.coalesce("count", F.lit(0)) > capacity
        leaves = leaves.unionAll(counted.where(~full).select("depth", "bucket"))
        over = counted.where(full)
        if depth == 64 or over.isEmpty():
            return materialised(leaves)
        depth += 1
        open_ = over.select(F.lit(depth).alias("depth"), F.explode(F.array(F.expr("bucket * 2"), F.expr("bucket * 2 + 1"))).alias("bucket"))


@dataclass(frozen=True)
class Index:
    """The files of an index: ``bucket`` pages of chained entries, one per distinct text."""

    entries: DataFrame
    directory: DataFrame


def _chained(texts: DataFrame, owner: list[str]) -> DataFrame:
    """``texts`` with ``chain``: its owner sorts the texts of a key and compares the bytes of neighbours."""
    within = Window.partitionBy(*owner, "key64").orderBy("text")
    fresh = F.coalesce((F.col("text") != F.lag("text").over(within)).cast("int"), F.lit(0))
    return texts.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0)))


def _hot(keys: DataFrame, hot_rows: int) -> DataFrame:
    """``key64, salts`` of the keys with more rows than one task should get: fewer than ``HOT_SHARE``."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    most = max(hot_rows, -(-total // HOT_SHARE))
    return keys.where(F.col("n") > most).select("key64", F.ceil(F.col("n") / most).alias("salts"))


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hot_rows: int = HOT_ROWS
) -> tuple[Index, DataFrame]:
    """The index of all texts, and ``key, key64, sha256`` of each row of ``docs``.

    The directory is made from the 64-bit keys. Then each text goes to the owner of its range of
    keys, a part of one bucket. The owner sorts its texts, compares the bytes of neighbours with the
    same key, and chains those that differ. The rows of a key with more than ``hot_rows`` rows (and
    more than a ``HOT_SHARE``-th of all) are dealt to several owners by the hash of ``key``, whose
    few survivors are compared once more. Entry: ``depth, bucket, key64, chain, sha256, keep_id,
    group_size``, one for each distinct text, in files of ranges of keys.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    named = named.select("id", "text", F.xxhash64("text").alias("key64"), F.unhex(F.sha2("text", 256)).alias("sha256"))
    rows = materialised(named.select("id", "key64", "sha256"))
    keys = materialised(rows.groupBy("key64").agg(F.count("*").alias("n")))
    where = directory(keys.select(F.col("key64").alias("key")), capacity)
    hot = materialised(_hot(keys, hot_rows))
    # An owner has a range of keys inside one bucket, and there are several for each task.
    depths = [r["depth"] for r in where.select("depth").distinct().orderBy("depth").collect()]
    bits = max(max(depths), (4 * shuffle_partitions(spark)).bit_length())
    dealt = named.join(F.broadcast(hot), "key64", "left").withColumns(
        {"owner": _prefix("key64", bits), "salt": F.coalesce(F.pmod(F.xxhash64("id"), "salts"), F.lit(-1).cast("long"))}
    )
    # Texts of hot keys are needed once more; elsewhere what tells them apart is the chain.
    texts = _chained(dealt.repartition("owner", "salt"), ["owner", "salt"]).withColumn("again", F.when(F.col("salt") >= 0, F.col("text")))
    found = texts.groupBy("owner", "salt", "key64", "chain", "sha256", "again").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size")
    )
    found = materialised(found)
    columns = ["key64", "chain", "sha256", "keep_id", "group_size"]
    parts = found.where("salt >= 0").drop("chain").withColumnRenamed("again", "text").repartition("owner")
    whole = _chained(parts, ["owner"]).groupBy("owner", "key64", "chain", "sha256").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    found = materialised(found.where("salt < 0").select(*columns).unionByName(whole.select(*columns)))
    # Each bucket is the range of the keys that begin with its bits.
    pages = None
    for depth in depths:
        here = where.where(F.col("depth") == depth).withColumnRenamed("bucket", "b")
        here = found.withColumn("bucket", _prefix("key64", depth)).join(here, F.col("bucket") == F.col("b")).drop("b")
        pages = here if pages is None else pages.unionByName(here)
    path = new_folder(spark)
    ordered = pages.repartitionByRange("depth", "bucket", "key64").sortWithinPartitions("depth", "bucket", "key64", "chain")
    ordered.write.parquet(path)
    return Index(spark.read.schema(ordered.schema).parquet(path), where), rows


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal if their bytes are; a missing text equals an empty one. Of equal texts the row
    with the largest key stays, a missing key being smaller than any; rows that share the largest
    key are all marked kept, and ``group_size`` counts rows. Other columns are left out.
    """
    index, rows = build_index(docs, key, text, capacity, hot_rows)
    found = lookup(rows, index.entries.select("key64", "sha256", "keep_id", "group_size"), ["key64", "sha256"])
    return found.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )
