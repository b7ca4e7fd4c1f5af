"""Smooth trends along one variable by local weighted fits at a few knots.

Knots lie at even ranks. At each the rows nearby, a given share of all, count with tricube weights,
and a straight line is fitted through their moments. Moments add up over tasks, so whatever
the number of rows, a knot is a row of a few numbers, and only these reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Knots, ranks looked at between two of them, and the share of all rows that count at one.
KNOTS = 16
FINE = 8
SPAN = 0.3


@dataclass(frozen=True)
class Knots:
    """Places in ascending order, and the distance within which rows count at each."""

    at: np.ndarray
    width: np.ndarray

    def weights(self, x: np.ndarray) -> np.ndarray:
        """Tricube weight of each value at each knot."""
        u = np.abs(np.asarray(x, float)[:, None] - self.at) / self.width
        return np.clip(1.0 - u**3, 0.0, None) ** 3

    def between(self, x: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Values at the knots (one or many each) carried to ``x``: straight between knots, constant beyond the ends."""
        x = np.asarray(x, float)
        if len(self.at) == 1:
            return np.repeat(values, len(x), axis=0)
        right = np.clip(np.searchsorted(self.at, x), 1, len(self.at) - 1)
        low, high = self.at[right - 1], self.at[right]
        share = np.clip((x - low) / (high - low), 0.0, 1.0)
        share = share.reshape(-1, *[1] * (values.ndim - 1))
        return values[right - 1] * (1.0 - share) + values[right] * share


def find_knots(df: DataFrame, x: str, knots: int = KNOTS, span: float = SPAN) -> Knots:
    """Knots at even ranks of ``x``; each reaches as far as ``span`` of the rows lie. Missing values are left out."""
    fine = knots * FINE
    grid = df.agg(F.percentile_approx(x, [k / fine for k in range(fine + 1)], 100 * fine)).first()[0]
    grid = np.array([] if grid is None else grid, float)
    if not len(grid):
        return Knots(np.zeros(1), np.ones(1))
    at = np.unique(grid[::FINE])
    away = np.sort(np.abs(at[:, None] - grid), axis=1)
    reach = away[:, min(len(grid) - 1, int(np.ceil(span * len(grid))))]
    # Where many values are equal a knot reaches to its neighbours at least.
    gap = np.diff(at).max(initial=0.0) or 1.0
    return Knots(at, np.where(reach > 0, 1.001 * reach, gap))


def moments(x: np.ndarray, y: np.ndarray, knots: Knots) -> np.ndarray:
    """For each knot the sums of ``w, w d, w d d``, then of ``w y`` and ``w d y`` for each column of ``y``; ``d`` is the way from the knot."""
    w = knots.weights(x)
    d = np.asarray(x, float)[:, None] - knots.at
    own = np.stack([w.sum(0), (w * d).sum(0), (w * d * d).sum(0)], axis=1)
    return np.concatenate([own, w.T @ y, (w * d).T @ y], axis=1)


def local_moments(df: DataFrame, x: str, y: str, knots: Knots) -> DataFrame:
    """``knot, sums``: :func:`moments` of all rows without missing values; ``y`` is a number or an array of them."""
    listed = F.col(y) if df.schema[y].dataType.typeName() == "array" else F.array(F.col(y).cast("double"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                part = moments(frame["x"].to_numpy(float), np.vstack(frame["y"].to_numpy()), knots)
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"knot": np.arange(len(total)), "sums": list(total)})

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), listed.alias("y"))
    parts = rows.mapInPandas(run, "knot long, sums array<double>").select("knot", F.posexplode("sums").alias("at", "s"))
    # A row for each knot and task.
    sums = parts.groupBy("knot", "at").agg(F.sum("s").alias("s")).groupBy("knot")
    return sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("sums"))


def local_lines(df: DataFrame, x: str, y: str, knots: Knots) -> np.ndarray:
    """The value at each knot of the line fitted there, one for each column of ``y``; a mean where all lie in one place."""
    rows = {r["knot"]: r["sums"] for r in local_moments(df, x, y, knots).collect()}
    if not rows:
        return np.zeros((len(knots.at), 1))
    sums = np.array([rows[k] for k in range(len(knots.at))])
    s0, s1, s2 = (sums[:, k, None] for k in range(3))
    t0, t1 = np.split(sums[:, 3:], 2, axis=1)
    spread = s0 * s2 - s1 * s1
    flat = spread <= 1e-9 * s0 * s2
    with np.errstate(all="ignore"):
        return np.where(flat, t0 / np.maximum(s0, 1e-300), (s2 * t0 - s1 * t1) / np.where(flat, 1.0, spread))
