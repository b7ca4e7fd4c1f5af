"""Principal components, projection onto a reference, and distances between profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialised
from .keyed import join_groups

# Profiles whose values one batch of feature rows carries at a time.
PROFILE_BLOCK = 2_000
# Samples of a component analysis, whose square table reaches the driver.
MAX_SAMPLES = 5_000


def cell_vectors(
    cells: DataFrame,
    expr: DataFrame,
    genes: Sequence[str],
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    vector: str = "embedding",
) -> DataFrame:
    """One dense vector per cell in the order of ``genes``, zero where nothing is stored."""
    names = list(genes)
    per_cell = (
        expr.filter(F.col(gene).isin(names))
        .groupBy(cell, gene)
        .agg(F.sum(value).alias("v"))
        .groupBy(cell)
        .agg(F.map_from_entries(F.collect_list(F.struct(gene, "v"))).alias("__v"))
    )
    filled = F.transform(
        F.array(*[F.lit(n) for n in names]), lambda g: F.coalesce(F.try_element_at("__v", g), F.lit(0.0))
    )
    return cells.join(per_cell, cell, "left").withColumn(vector, filled).drop("__v")


def cell_pca(
    vectors: DataFrame, k: int = 20, *, cell: str = "cell_id", vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """Centred principal components: (scores per cell, share of variance per component).

    The sign of a component makes its largest loading positive.  The fit is one distributed
    pass for the covariance of the features, of which there are hundreds.
    """
    prepared = vectors.select(cell, array_to_vector(F.col(vector).cast("array<double>")).alias("__raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__c").fit(prepared)
    table = centred.transform(prepared)
    model = PCA(k=k, inputCol="__c", outputCol="__s").fit(table)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])])
    flips = F.array(*[F.lit(float(s)) for s in signs])
    scores = model.transform(table).select(
        cell, F.zip_with(vector_to_array("__s"), flips, lambda x, s: x * s).alias("pca")
    )
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    explained = vectors.sparkSession.createDataFrame(shares, "component INT, explained DOUBLE")
    return scores, explained


def _pairwise(
    long: DataFrame,
    profile: str,
    feature: str,
    value: str,
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
    block: int = PROFILE_BLOCK,
) -> DataFrame:
    """Sum over features of a function of two profiles' values: ``id_1 <= id_2, total``.

    A feature row carries the values of one or two blocks of profiles; each batch of rows adds
    to one table per partition, so the pairs are not written out per feature.  The table of
    all pairs is the result and sets how many profiles there can be.
    """
    rows = materialised(
        long.filter(F.col(profile).isNotNull())
        .groupBy(feature)
        .agg(F.map_from_entries(F.collect_list(F.struct(profile, F.col(value).cast("double").alias("v")))).alias("__m"))
    )
    names = rows.select(F.explode(F.map_keys("__m"))).distinct().limit(MAX_SAMPLES + 1).collect()
    if len(names) > MAX_SAMPLES:
        raise ValueError(f"tables of all pairs are meant for at most {MAX_SAMPLES} profiles")
    ids = sorted(row[0] for row in names)
    blocks = [ids[start : start + block] for start in range(0, len(ids), block)] or [[]]
    id_type = long.schema[profile].dataType.simpleString()

    def values(names):
        listed = F.array(*[F.lit(n) for n in names])
        return F.transform(listed, lambda n: F.coalesce(F.try_element_at("__m", n), F.lit(0.0)))

    def table(first: list, second: list) -> DataFrame:
        def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(first), len(second)))
            for frame in frames:
                if len(frame):
                    total += combine(np.vstack(frame["x"].to_numpy()), np.vstack(frame["y"].to_numpy()))
            i, j = np.triu_indices(len(first)) if first is second else np.indices(total.shape).reshape(2, -1)
            left, right = np.array(first, object)[i], np.array(second, object)[j]
            yield pd.DataFrame({"id_1": left, "id_2": right, "part": total[i, j]})

        dense = rows.select(values(first).alias("x"), values(second).alias("y"))
        return dense.mapInPandas(add_up, f"id_1 {id_type}, id_2 {id_type}, part DOUBLE")

    tables = [table(a, b) for n, a in enumerate(blocks) for b in blocks[n:] if a]
    if not tables:
        return long.sparkSession.createDataFrame([], f"id_1 {id_type}, id_2 {id_type}, total DOUBLE")
    return reduce(DataFrame.unionByName, tables).groupBy("id_1", "id_2").agg(F.sum("part").alias("total"))


def _squared_differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over the rows by three products; where they cancel, which loses digits, the differences themselves."""
    size = (x * x).sum(axis=0)[:, None] + (y * y).sum(axis=0)[None, :]
    total = size - 2.0 * (x.T @ y)
    i, j = np.nonzero(total < 1e-6 * size)
    for start in range(0, len(i), 4_096):
        a, b = i[start : start + 4_096], j[start : start + 4_096]
        total[a, b] = ((x[:, a] - y[:, b]) ** 2).sum(axis=0)
    return total


def profile_distances(
    long: DataFrame, profile: str, feature: str, value: str, *, block: int = PROFILE_BLOCK
) -> DataFrame:
    """Euclidean distance of every pair of profiles (``id_1 < id_2``); a missing value is 0.

    ``long`` has one row per profile and feature.
    """
    sums = _pairwise(long, profile, feature, value, _squared_differences, block).filter("id_1 < id_2")
    return sums.select("id_1", "id_2", F.sqrt("total").alias("distance"))


def standardised(long: DataFrame, feature: str, value: str, name: str = "x") -> DataFrame:
    """Values centred and scaled per feature; features without variance are dropped."""
    stats = long.groupBy(feature).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    usable = stats.filter(F.col("__sd") > 0)
    return join_groups(long, usable, [feature], "inner").withColumn(
        name, (F.col(value) - F.col("__mean")) / F.col("__sd")
    ).drop("__mean", "__sd")


def sample_gram(long: DataFrame, sample: str = "sample", gene: str = "gene", value: str = "log_cpm") -> DataFrame:
    """Inner products of the standardised profiles of all pairs of samples (``id_1 <= id_2``)."""
    sums = _pairwise(standardised(long, gene, value), sample, gene, "x", lambda x, y: x.T @ y)
    return sums.withColumnRenamed("total", "product")


def sample_pca(
    long: DataFrame, k: int = 4, *, sample: str = "sample", gene: str = "gene", value: str = "log_cpm"
) -> DataFrame:
    """Scores of the pseudobulk samples on their first components, genes scaled.

    The genes are reduced on the executors to a table of samples by samples, tens of rows,
    whose eigenvectors give the scores.  The sign makes the largest score of a component
    positive.
    """
    gram = sample_gram(long, sample, gene, value).toPandas()
    ids = sorted(set(gram["id_1"]) | set(gram["id_2"]))
    place = {name: i for i, name in enumerate(ids)}
    matrix = np.zeros((len(ids), len(ids)))
    i, j = gram["id_1"].map(place).to_numpy(int), gram["id_2"].map(place).to_numpy(int)
    matrix[i, j] = matrix[j, i] = gram["product"]
    values, vectors = np.linalg.eigh(matrix)
    keep = np.argsort(values)[::-1][:k]
    scores = vectors[:, keep] * np.sqrt(np.maximum(values[keep], 0.0))
    scores *= np.sign(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])])
    columns = [f"PC{c + 1}" for c in range(scores.shape[1])]
    rows = [(name, *map(float, scores[place[name]])) for name in ids]
    id_type = long.schema[sample].dataType.simpleString()
    schema = f"{sample} {id_type}, " + ", ".join(f"{c} DOUBLE" for c in columns)
    return long.sparkSession.createDataFrame(rows, schema)


def project(
    expr: DataFrame,
    cells: DataFrame,
    loadings: DataFrame,
    k: int,
    *,
    cell: str = "cell_id",
    gene: str = "gene",
    value: str = "logcount",
    vector: str = "embedding",
) -> DataFrame:
    """Scores of the cells on reference components.

    ``loadings`` has ``gene, mean, sd, weights`` with ``k`` weights.  Only stored values are
    summed; the share of the zeros, ``-mean / sd * weight`` of every gene, is one constant per
    component.
    """
    scale = loadings.filter(F.col("sd") > 0).select(
        gene,
        *[(F.get("weights", F.lit(i)) / F.col("sd")).alias(f"__w{i}") for i in range(k)],
        F.col("mean").alias("__mean"),
    )
    base = scale.agg(F.array(*[F.sum(-F.col("__mean") * F.col(f"__w{i}")) for i in range(k)]).alias("b")).scalar()
    sums = (
        expr.join(scale, gene)
        .groupBy(cell)
        .agg(F.array(*[F.sum(F.col(value) * F.col(f"__w{i}")) for i in range(k)]).alias("__s"))
    )
    joined = cells.join(sums, cell, "left").withColumn("__b", base)
    zeros = F.array(*[F.lit(0.0)] * k)
    return joined.withColumn(
        vector, F.zip_with(F.coalesce("__s", zeros), F.col("__b"), lambda s, b: s + b)
    ).drop("__s", "__b")


def align_donors(scores: DataFrame, donor: str, *, vector: str = "embedding") -> DataFrame:
    """Shift the cells of each donor so that the donor centroids coincide with the overall one.

    A plain centroid shift, simpler than a mixture model of batches and not equal to it.
    """
    prepared = scores.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    mean = vector_to_array(Summarizer.mean(F.col("__v")))
    joined = join_groups(scores, prepared.groupBy(donor).agg(mean.alias("__donor")), [donor]).withColumn(
        "__all", prepared.agg(mean.alias("o")).scalar()
    )
    shift = F.zip_with("__all", "__donor", lambda a, d: a - d)
    return joined.withColumn(vector, F.zip_with(F.col(vector), shift, lambda x, s: x + s)).drop("__donor", "__all")
