"""Helpers that several of the operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.session import materialised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, a missing text being empty."""
    return F.coalesce(F.col(name), F.lit(""))


def _larger_to_smaller(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = materialised(edges.union(edges.select("b", "a")))
    least = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = materialised(edges.groupBy("a").agg(F.min("b").alias("m")))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of the graph with the links ``a, b``; nodes without a link are absent.

    ``component`` is the smallest node that can be reached. Links are contracted by the
    alternating large-star and small-star steps until nothing changes, which takes a number of
    rounds logarithmic in the longest path; every step is a partial aggregate and a join.
    """
    edges = materialised(_larger_to_smaller(edges))
    state = None
    while True:
        row = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if row["n"] == 0 or (row["n"], row["s"]) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = (row["n"], row["s"])
        large = materialised(_larger_to_smaller(_large_star(edges)))
        edges = materialised(_larger_to_smaller(_small_star(large)))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` positions the smallest one that the links ``i, j`` reach."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def products(a0: np.ndarray, a: np.ndarray, b0: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the ranges ``a0 .. a0 + a`` and ``b0 .. b0 + b``; of equal ranges each pair once, and itself."""
    total = a * b
    which = np.repeat(np.arange(len(total)), total)
    k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    i, j = a0[which] + k // b[which], b0[which] + k % b[which]
    keep = (i <= j) | ~same[which]
    return i[keep], j[keep]


def lookup(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner", share: int = 1_000) -> DataFrame:
    """``rows`` joined with the row that ``facts`` has for their key ``on``, whatever keys are frequent.

    Keys with more than one in ``share`` of the rows, which are fewer than ``share``, are broadcast with their
    facts; only the others are shuffled, and none of them fills a task. Both tables are read more
    than once: pass written ones. Rows without facts, or with a missing key, go, or stay with ``how="left"``.
    """
    counts = materialised(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") * share > total).select(*on)
    hot_facts = F.broadcast(materialised(F.broadcast(hot).join(facts, on, how)))
    rest = rows.join(F.broadcast(hot), on, "left_anti").join(facts, on, how)
    return rows.join(hot_facts, on).unionByName(rest)
