"""Donor correction by soft clusters: donors may be shifted differently in each kind of cell."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialised
from .keyed import join_groups

# Cells that one group of rows holds, about.
BLOCK_CELLS = 10_000
# Clusters of a correction at most; their centroids are all that reaches the driver.
MAX_CLUSTERS = 100


def _responsibilities(x: np.ndarray, centroids: np.ndarray, bias: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and the share of each cluster in each row: near on the sphere, and short of the row's donor."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm > 0, norm, 1.0)
    score = -2.0 * (1.0 - unit @ centroids.T) / width + bias
    score -= score.max(axis=1, keepdims=True)
    share = np.exp(score)
    return unit, share / share.sum(axis=1, keepdims=True)


def ridge_shifts(moments: DataFrame, penalty: float = 1.0, *, cluster: str = "cluster", donor: str = "donor") -> DataFrame:
    """``cluster, donor, shift``: what each donor adds to each cluster, by ridge regression per cluster.

    ``moments`` has a row ``cluster, donor, n, s`` for each pair: the summed weights of the cells and
    their weighted sum. The model of a cluster is a free mean plus one ``penalty``-ised shift per
    donor; its normal equations are diagonal but for the mean, so that they are solved by sums over
    the donors. Pairs without weight have shift 0.
    """
    held = moments.withColumn("__f", F.lit(float(penalty)) / (F.col("n") + float(penalty)))
    whole = Window.partitionBy(cluster)
    # The mean weighs each donor by penalty * n / (n + penalty): a large donor does not own the cluster.
    terms = held.select(
        cluster, donor, "n", "s", (F.col("n") * F.col("__f")).alias("__w"), F.posexplode("s").alias("__i", "__s"), "__f"
    )
    place = Window.partitionBy(cluster, "__i")
    mean = F.try_divide(F.sum(F.col("__s") * F.col("__f")).over(place), F.sum("__w").over(place))
    shift = F.try_divide(F.col("__s") - F.col("n") * mean, F.col("n") + float(penalty))
    solved = terms.withColumn("__shift", F.coalesce(shift, F.lit(0.0)))
    listed = solved.groupBy(cluster, donor).agg(F.array_sort(F.collect_list(F.struct("__i", "__shift"))).alias("l"))
    return listed.select(cluster, donor, F.col("l.__shift").alias("shift"))


def _sums(cells: DataFrame, facts: DataFrame, centroids: np.ndarray, width: float, original: bool) -> DataFrame:
    """``donor, cluster, n, s`` of all cells: sums of shares, and of the (unit or original) rows they weigh."""
    k, _ = centroids.shape

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"donor": [], "cluster": [], "n": [], "s": []})
        x = np.stack(left["now"].to_numpy())
        unit, share = _responsibilities(x, centroids, right["bias"].iloc[0], width)
        rows = np.stack(left["first"].to_numpy()) if original else unit
        return pd.DataFrame(
            {"donor": left["donor"].iloc[0], "cluster": np.arange(k), "n": share.sum(axis=0), "s": list(share.T @ rows)}
        )

    parts = _together(cells, facts, block, "donor long, cluster int, n double, s array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector("s")))
    return materialised(parts.groupBy("donor", "cluster").agg(F.sum("n").alias("n"), total.alias("s")))


def _corrector(centroids: np.ndarray, width: float) -> Callable:
    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left):
            share = _responsibilities(np.stack(left["now"].to_numpy()), centroids, right["bias"].iloc[0], width)[1]
            off = share @ np.asarray(right["shift"].iloc[0]).reshape(centroids.shape)
            left = left.assign(now=list(np.stack(left["first"].to_numpy()) - off))
        return left

    return block


def _together(cells: DataFrame, facts: DataFrame, block: Callable, schema: str) -> DataFrame:
    """``block`` of each group of cells and the one row that ``facts`` has for its donor."""
    spread = facts.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["donor", "block"]
    return cells.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(block, schema)


def _biases(sums: DataFrame, diversity: float) -> DataFrame:
    """``donor, cluster, bias``: how far a cluster falls short of the donor's share of all cells."""
    expected = F.sum("n").over(Window.partitionBy("cluster")) * F.sum("n").over(Window.partitionBy("donor"))
    expected = expected / sums.agg(F.sum("n").alias("n")).scalar()
    return sums.select("donor", "cluster", (float(diversity) * F.log((expected + 1) / (F.col("n") + 1))).alias("bias"))


def align_donors_softly(
    scores: DataFrame,
    donor: str,
    *,
    cell: str = "cell_id",
    vector: str = "embedding",
    clusters: int = 20,
    rounds: int = 5,
    steps: int = 2,
    width: float = 0.1,
    diversity: float = 2.0,
    penalty: float = 1.0,
    seed: int = 1,
    block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """``scores`` with vectors from which the donors' shifts within each soft cluster are taken.

    Cells are assigned to clusters on the unit sphere with shares that fall with the distance
    over ``width`` and favour clusters in which the cell's donor is short (``diversity``; half the
    old preference is kept, so that donors do not swing between clusters). After ``steps`` of this, the
    shifts of the donors follow from one ridge regression per cluster of the vectors as given, and each
    cell loses the shifts of its donor in proportion to its shares. Then the next of ``rounds`` begins.

    Tasks send sums per donor and cluster; only the centroids reach the driver. Rows without a cell
    name, donor or vector, or with a missing or non-finite component, stay as they are; so do rows that share
    a name with another row of a different vector, by the vector of which one is chosen (the least).
    """
    if not 1 <= clusters <= MAX_CLUSTERS:
        raise ValueError(f"clusters must be 1 to {MAX_CLUSTERS}")
    spark = scores.sparkSession
    whole = ~F.exists("first", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = scores.select(F.col(cell).alias("cell"), F.col(donor).alias("name"), F.col(vector).cast("array<double>").alias("first"))
    given = given.where("cell is not null and name is not null and first is not null").where(whole)
    given = materialised(given.groupBy("cell", "name").agg(F.min("first").alias("first")))
    names = materialised(given.groupBy("name").agg(F.count("*").alias("__n"))).withColumn(
        "blocks", F.ceil(F.col("__n") / block_cells).cast("int")
    )
    names = materialised(names.select("name", "blocks", F.xxhash64(F.col("name").cast("string")).alias("donor")))
    cells = join_groups(given, names, ["name"]).withColumns(
        {"block": F.pmod(F.xxhash64("cell"), "blocks").cast("int"), "now": F.col("first")}
    )
    cells = materialised(cells.select("cell", "name", "donor", "block", "first", "now"))
    if cells.isEmpty():
        return scores
    norm = F.sqrt(F.aggregate("first", F.lit(0.0), lambda a, x: a + x * x))
    units = cells.select(F.transform("first", lambda x: x / norm).alias("u")).where(norm > 0)
    fit = KMeans(k=clusters, seed=seed, maxIter=10, featuresCol="v").fit(units.select(array_to_vector("u").alias("v")))
    centroids = _unit(np.stack(fit.clusterCenters()))
    k = len(centroids)
    facts = names.select("donor", "blocks")
    bias = spark.range(k).select(F.col("id").cast("int").alias("cluster"), F.lit(0.0).alias("bias"))
    bias = materialised(facts.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(bias, "cluster").drop("blocks"))
    for _ in range(rounds):
        for _ in range(steps):
            sums = _sums(cells, facts.join(_listed(bias, "bias"), "donor"), centroids, width, False)
            new = _biases(sums, diversity).withColumnRenamed("bias", "new")
            bias = materialised(bias.join(new, ["donor", "cluster"]).select("donor", "cluster", ((F.col("bias") + F.col("new")) / 2).alias("bias")))
            centres = sums.groupBy("cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).orderBy("cluster").collect()
            centroids = _unit(np.array([r["s"] for r in centres]))
        known = facts.join(_listed(bias, "bias"), "donor")
        shifts = ridge_shifts(_sums(cells, known, centroids, width, True), penalty)
        known = known.join(_listed(shifts, "shift").withColumn("shift", F.flatten("shift")), "donor")
        cells = materialised(_together(cells, known, _corrector(centroids, width), cells.schema.simpleString()[len("struct<"):-1]))
    moved = cells.select(F.col("cell").alias("__cell"), F.col("name").alias("__name"), F.col("first").alias("__first"), F.col("now").alias("__now"))
    same = (F.col(cell) == F.col("__cell")) & (F.col(donor) == F.col("__name"))
    same = same & (F.col(vector).cast("array<double>") == F.col("__first"))
    joined = scores.join(moved, same, "left")
    return joined.withColumn(vector, F.coalesce("__now", F.col(vector).cast("array<double>"))).drop("__cell", "__name", "__first", "__now")


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1.0)


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """``donor`` and the values of its clusters in their order."""
    listed = rows.groupBy("donor").agg(F.array_sort(F.collect_list(F.struct("cluster", name))).alias("l"))
    return listed.select("donor", F.col(f"l.{name}").alias(name))
