"""Negative-binomial models of pseudobulk counts: dispersion and likelihood-ratio tests.

A gene is one row with its counts in all samples; Spark spreads the genes and a batch of them
is fitted at once with numpy.  The design has tens of rows and travels with the function.  The
dispersion follows a trend along the abundance, and how far a gene is drawn to it is estimated from
the scatter of its residual deviance.  The trend is smoothed in its own way, so the numbers are
close to, not equal to, those of the established packages.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import chi2_upper
from ..session import materialised, shuffle_partitions
from .multiple import adjust_p
from .trend import Knots, find_knots, local_lines

MAX_SAMPLES = 5_000
# Dispersions 0.1 * 2^-10 .. 0.1 * 2^10, and prior counts of the published method.
GRID = 0.1 * 2.0 ** np.linspace(-10, 10, 21)
FOLD_PRIOR = 0.125
CPM_PRIOR = 2.0
#: Relative change of the deviance at which a fit has converged; rounds that it goes on for, to be exact as well.
TOLERANCE, POLISH = 1e-8, 2
#: Least weight of a count in the adjustment of the likelihood: in a group of zeros the fitted mean would go on falling.
LEAST_WEIGHT = 1e-6


@dataclass(frozen=True)
class Design:
    """Model matrix of the samples, with named columns."""

    samples: tuple[str, ...]
    columns: tuple[str, ...]
    matrix: np.ndarray

    def contrast(self, weights: str | Mapping[str, float]) -> np.ndarray:
        """Weights of a coefficient, or of a combination such as ``{"group3": 1, "group2": -1}``."""
        named = {weights: 1.0} if isinstance(weights, str) else dict(weights)
        vector = np.zeros(len(self.columns))
        for name, weight in named.items():
            vector[self.columns.index(name)] = weight
        return vector


def design_matrix(
    samples: DataFrame,
    factors: Mapping[str, str | None],
    numeric: Sequence[str] = (),
    *,
    sample: str = "sample",
) -> Design:
    """Intercept, treatment-coded factors and numeric columns from the sample table.

    ``factors`` maps a column to its reference level, by default the first in name order.
    """
    rows = samples.select(sample, *factors, *numeric).distinct().limit(MAX_SAMPLES + 1).toPandas()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"a design is meant for at most {MAX_SAMPLES} samples")
    rows = rows.sort_values(sample, ignore_index=True)
    if rows[sample].duplicated().any() or rows.isna().any().any():
        raise ValueError("a sample needs exactly one row without missing values")
    names, parts = ["(Intercept)"], [np.ones(len(rows))]
    for column, reference in factors.items():
        levels = sorted(rows[column].unique())
        base = levels[0] if reference is None else reference
        if base not in levels:
            raise ValueError(f"{base!r} is not a level of {column}")
        for level in levels:
            if level != base:
                names.append(f"{column}{level}")
                parts.append((rows[column] == level).to_numpy(float))
    for column in numeric:
        names.append(column)
        parts.append(rows[column].to_numpy(float))
    matrix = np.column_stack(parts)
    if np.linalg.matrix_rank(matrix) < matrix.shape[1]:
        raise ValueError(f"coefficients cannot be told apart: {names}")
    return Design(tuple(rows[sample]), tuple(names), matrix)


def _gene_rows(pb: DataFrame, design: Design, sample: str, gene: str, count: str) -> DataFrame:
    """One row per gene with its counts in the order of the design; absent counts are 0."""
    found = (
        pb.filter(F.col(sample).isin(list(design.samples)))
        .groupBy(gene, sample)
        .agg(F.sum(count).cast("double").alias("c"))
        .groupBy(gene)
        .agg(F.map_from_entries(F.collect_list(F.struct(sample, "c"))).alias("__m"))
    )
    filled = F.transform(
        F.array(*[F.lit(s) for s in design.samples]), lambda s: F.coalesce(F.try_element_at("__m", s), F.lit(0.0))
    )
    # A fixed number of partitions: the fits take long for their bytes, so small ones must not merge.
    return found.select(gene, filled.alias("y")).repartition(shuffle_partitions(pb.sparkSession), gene)


def _effective_sizes(factors: DataFrame, design: Design, sample: str) -> np.ndarray:
    chosen = factors.filter(F.col(sample).isin(list(design.samples)))
    sizes = {row[0]: row[1] for row in chosen.select(sample, F.col("lib_size") * F.col("norm_factor")).collect()}
    return np.array([sizes[s] for s in design.samples], float)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    while (low := x < 8.0).any():
        shift[low] += np.log(x[low])
        x[low] += 1.0
    inverse = 1.0 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - shift


def _deviance(y: np.ndarray, mu: np.ndarray, phi: np.ndarray) -> np.ndarray:
    size = 1.0 / phi
    own = np.where(y > 0, y * np.log(np.where(y > 0, y, 1.0) / mu), 0.0)
    return 2.0 * (own - (y + size) * np.log((y + size) / (mu + size))).sum(axis=1)


def _fit(y: np.ndarray, x: np.ndarray, offset: np.ndarray, phi: np.ndarray, rounds: int = 50, start: np.ndarray | None = None):
    """Fisher scoring for all rows of ``y`` together: coefficients, means, deviances, information, converged."""
    phi = phi[:, None]

    def means(b):
        return np.exp(np.clip(b @ x.T + offset, -50.0, 50.0))

    beta = (np.log(y + 0.5) - offset) @ np.linalg.pinv(x).T if start is None else start
    mu = means(beta)
    deviance = _deviance(y, mu, phi)
    settled, calm = np.zeros(len(y), bool), np.zeros(len(y), int)
    for _ in range(rounds):
        weight = mu / (1.0 + phi * mu)
        information = np.einsum("gs,sp,sq->gpq", weight, x, x, optimize=True) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(information, (((y - mu) / (1.0 + phi * mu)) @ x)[:, :, None])[:, :, 0]
        scale = np.ones(len(y))
        for _ in range(12):
            trial = beta + scale[:, None] * step
            moved = means(trial)
            now = _deviance(y, moved, phi)
            worse = now > deviance + 1e-8
            if not worse.any():
                break
            scale[worse] *= 0.5
        trial[worse], moved[worse], now[worse] = beta[worse], mu[worse], deviance[worse]
        settled = np.abs(deviance - now) < TOLERANCE * (1.0 + np.abs(now))
        calm = np.where(settled, calm + 1, 0)
        beta, mu, deviance = trial, moved, now
        if (calm > POLISH).all():
            break
    weight = mu / (1.0 + phi * mu)
    information = np.einsum("gs,sp,sq->gpq", weight, x, x, optimize=True) + 1e-9 * np.eye(x.shape[1])
    return beta, mu, deviance, information, settled


def _profile(y: np.ndarray, x: np.ndarray, offset: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjusted profile likelihood of every gene at every dispersion of the grid, and whether all its fits converged."""
    curve, settled, beta = np.empty((len(y), len(grid))), np.ones(len(y), bool), None
    for i, value in enumerate(grid):
        phi = np.full(len(y), value)
        # The fit at the dispersion before is near.
        beta, mu, _, _, done = _fit(y, x, offset, phi, start=beta)
        settled &= done
        weight = np.maximum(mu / (1.0 + value * mu), LEAST_WEIGHT)
        information = np.einsum("gs,sp,sq->gpq", weight, x, x, optimize=True)
        size = 1.0 / value
        likelihood = (
            _log_gamma(y + size)
            - _log_gamma(np.full_like(y, size))
            - _log_gamma(y + 1.0)
            + size * np.log(size / (size + mu))
            + y * np.log(mu / (size + mu))
        ).sum(axis=1)
        curve[:, i] = likelihood - 0.5 * np.linalg.slogdet(information)[1]
    return curve, settled


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 8.0:
        shift, x = shift - 1.0 / x, x + 1.0
    inverse = 1.0 / (x * x)
    return shift + np.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252))


def _trigamma(x: float) -> float:
    shift = 0.0
    while x < 8.0:
        shift, x = shift + 1.0 / (x * x), x + 1.0
    inverse = 1.0 / (x * x)
    return shift + 1.0 / x + 0.5 * inverse + inverse / x * (1 / 6 - inverse * (1 / 30 - inverse / 42))


def _trigamma_inverse(value: float) -> float:
    """By bisection on the logarithm: the function falls from infinity to 0."""
    low, high = -20.0, 20.0
    for _ in range(80):
        middle = 0.5 * (low + high)
        low, high = (middle, high) if _trigamma(float(np.exp(middle))) > value else (low, middle)
    return float(np.exp(0.5 * (low + high)))


def _peaks(curves: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the dispersion at which each curve is highest, interpolated by a parabola, and the grid point below it."""
    at = curves.argmax(axis=1)
    row, inner = np.arange(len(at)), (at > 0) & (at < len(grid) - 1)
    left, top, right = (curves[row, np.clip(at + k, 0, len(grid) - 1)] for k in (-1, 0, 1))
    bend = 2.0 * (left - 2.0 * top + right)
    shift = np.where(inner & (bend < 0), (left - right) / np.where(bend < 0, bend, -1.0), 0.0)
    return np.log2(grid[at]) + shift * np.log2(grid[1] / grid[0]), at


def profile_curves(
    pb: DataFrame,
    factors: DataFrame,
    design: Design,
    *,
    grid: Sequence[float] = tuple(GRID),
    sample: str = "sample",
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """Per gene: its counts ``y``, ``level`` (mean log2 counts per million), and ``curve``.

    ``curve`` is the adjusted profile likelihood at each dispersion of the grid; ``converged`` says whether all
    the fits behind it came to rest.
    """
    sizes, x, grid = _effective_sizes(factors, design, sample), design.matrix, np.array(grid, float)
    offset, prior = np.log(sizes), CPM_PRIOR * sizes / sizes.mean()

    def curves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                y = np.vstack(frame["y"].to_numpy())
                values, settled = _profile(y, x, offset, grid)
                level = np.log2(((y + prior) / (sizes + 2.0 * prior) * 1e6).mean(axis=1))
                columns = {"level": level, "curve": list(values), "converged": settled}
                yield pd.DataFrame({gene: frame[gene].to_numpy(), "y": list(y), **columns})

    rows = _gene_rows(pb, design, sample, gene, count)
    id_type = rows.schema[gene].dataType.simpleString()
    return rows.mapInPandas(curves, f"{gene} {id_type}, y ARRAY<DOUBLE>, level DOUBLE, curve ARRAY<DOUBLE>, converged BOOLEAN")


def _prior_df(own: DataFrame, x: np.ndarray, offset: np.ndarray, knots: Knots, trend: np.ndarray) -> float:
    """Prior degrees of freedom from the scatter of the residual deviances about their own trend.

    Deviances at the trended dispersion, over the residual degrees of freedom, scatter like variances: their
    logarithms as much as chance has it, and beyond that as much as genes differ. No more than
    chance: infinite.
    """
    residual = max(1, x.shape[0] - x.shape[1])

    def logs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                y = np.vstack(frame["y"].to_numpy())
                phi = 2.0 ** knots.between(frame["level"].to_numpy(), trend)
                _, _, deviance, _, settled = _fit(y, x, offset, phi)
                value = np.log(np.maximum(deviance / residual, 1e-5)) - _digamma(residual / 2.0) + np.log(residual / 2.0)
                yield pd.DataFrame({"level": frame["level"].to_numpy(), "e": value})[settled]

    scatter = materialised(own.where("converged").select("y", "level").mapInPandas(logs, "level DOUBLE, e DOUBLE"))
    middle = local_lines(scatter, "level", "e", knots)[:, 0]

    def squares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                gone = frame["e"].to_numpy() - knots.between(frame["level"].to_numpy(), middle)
                yield pd.DataFrame({"n": [len(gone)], "s": [float(gone @ gone)]})

    found = scatter.mapInPandas(squares, "n LONG, s DOUBLE").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not found["n"]:
        return float("inf")
    beyond = found["s"] / found["n"] - _trigamma(residual / 2.0)
    return 2.0 * _trigamma_inverse(beyond) if beyond > 0 else float("inf")


def estimate_dispersion(
    pb: DataFrame,
    factors: DataFrame,
    design: Design,
    *,
    prior_df: float | None = None,
    grid: Sequence[float] = tuple(GRID),
    sample: str = "sample",
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """Per gene: ``common``, ``trended`` and own ``dispersion``, ``prior_df``, ``at_bound`` and ``converged``.

    The likelihood curves of the genes are averaged, over all for ``common`` and by local lines along the
    abundance for ``trended``. The curve of a gene is added to that of its abundance, weighted by ``prior_df`` over
    the residual degrees of freedom, and its maximum is interpolated between grid points. ``prior_df`` is
    estimated from the residual deviances unless given; infinite, every gene has the trended value.

    The grid spans six decades; a maximum at one of its ends says that the data favour a
    dispersion beyond it, and is marked. Curves whose fits have not ``converged`` do not count in the
    averages. Collected: a few numbers for each knot of the trend.
    """
    grid = np.array(grid, float)
    x, offset = design.matrix, np.log(_effective_sizes(factors, design, sample))
    own = materialised(profile_curves(pb, factors, design, grid=grid, sample=sample, gene=gene, count=count))
    good = own.where("converged")
    knots = find_knots(good, "level")
    whole = Knots(np.zeros(1), np.full(1, np.inf))
    shared = local_lines(good, "level", "curve", knots)
    if shared.shape[1] != len(grid):  # no gene at all
        shared = np.zeros((len(knots.at), len(grid)))
    # Rows count alike here, so the mean is what a flat line gives.
    overall = good.select(F.lit(0.0).alias("x"), "curve")
    common = float(2.0 ** _peaks(local_lines(overall, "x", "curve", whole), grid)[0][0]) if not good.isEmpty() else float("nan")
    trend = _peaks(shared, grid)[0]
    if prior_df is None:
        prior_df = _prior_df(own, x, offset, knots, trend)
    weight = prior_df / max(1, x.shape[0] - x.shape[1])

    def estimate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                level = frame["level"].to_numpy()
                local = knots.between(level, shared)
                if np.isfinite(weight):
                    peak, at = _peaks(np.vstack(frame["curve"].to_numpy()) + weight * local, grid)
                else:
                    peak, at = _peaks(local, grid)
                columns = {"common": common, "trended": 2.0 ** knots.between(level, trend), "dispersion": 2.0**peak, "prior_df": prior_df}
                columns |= {"at_bound": (at == 0) | (at == len(grid) - 1), "converged": frame["converged"].to_numpy()}
                yield pd.DataFrame({gene: frame[gene].to_numpy(), **columns})

    id_type = own.schema[gene].dataType.simpleString()
    schema = f"{gene} {id_type}, common DOUBLE, trended DOUBLE, dispersion DOUBLE, prior_df DOUBLE, at_bound BOOLEAN, converged BOOLEAN"
    return own.select(gene, "level", "curve", "converged").mapInPandas(estimate, schema)


def pseudobulk_de(
    pb: DataFrame,
    factors: DataFrame,
    design: Design,
    contrasts: Mapping[str, str | Mapping[str, float]],
    *,
    dispersion: DataFrame | None = None,
    method: str = "holm",
    sample: str = "sample",
    gene: str = "gene",
    count: str = "count",
) -> DataFrame:
    """Likelihood-ratio test of every contrast for every gene, sorted by p-value.

    A contrast is tested against the model whose coefficients satisfy it with zero.  Fold
    changes (log2) come from a fit with a small prior count, ``log_cpm`` from the mean over
    the samples.  Adjusted p-values are per contrast.  A gene whose fits have not ``converged`` has
    no test.
    """
    sizes = _effective_sizes(factors, design, sample)
    offset, x = np.log(sizes), design.matrix
    tests = {name: design.contrast(weights) for name, weights in contrasts.items()}
    reduced = {}
    for name, vector in tests.items():
        null_space = np.linalg.svd(vector[None, :])[2][1:].T
        reduced[name] = x @ null_space
    relative = sizes / sizes.mean()
    fold_prior, cpm_prior = FOLD_PRIOR * relative, CPM_PRIOR * relative

    def test(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            y, phi = np.vstack(frame["y"].to_numpy()), frame["dispersion"].to_numpy(float)
            full, whole = _fit(y, x, offset, phi)[2::2]
            folds = _fit(y + fold_prior, x, np.log(sizes + 2.0 * fold_prior), phi)[0] / np.log(2.0)
            level = np.log2(((y + cpm_prior) / (sizes + 2.0 * cpm_prior) * 1e6).mean(axis=1))
            for name, vector in tests.items():
                null, settled = _fit(y, reduced[name], offset, phi)[2::2]
                settled &= whole
                ratio = np.where(settled, np.maximum(null - full, 0.0), np.nan)
                yield pd.DataFrame(
                    {
                        gene: frame[gene].to_numpy(),
                        "contrast": name,
                        "log_fc": folds @ vector,
                        "log_cpm": level,
                        "lr": [None if np.isnan(r) else r for r in ratio],
                        "converged": settled,
                    }
                )

    if dispersion is None:
        dispersion = estimate_dispersion(pb, factors, design, sample=sample, gene=gene, count=count)
    rows = dispersion.select(gene, "dispersion").join(_gene_rows(pb, design, sample, gene, count), gene)
    id_type = rows.schema[gene].dataType.simpleString()
    schema = f"{gene} {id_type}, contrast STRING, log_fc DOUBLE, log_cpm DOUBLE, lr DOUBLE, converged BOOLEAN"
    tested = rows.mapInPandas(test, schema).withColumn("lr", F.nanvl("lr", F.lit(None).cast("double")))
    tested = tested.withColumn("p_value", F.when(F.col("lr").isNotNull(), chi2_upper("lr")))
    return adjust_p(tested, "p_value", ["contrast"], method).orderBy("contrast", "p_value", gene)
