"""Donor correction by soft clusters."""

import numpy as np
import pytest

from cohortframe.operators import donors, embed

SCHEMA = "cell_id long, donor string, embedding array<double>, first int"


def simulated():
    """Two kinds of cells; the second donor is shifted up in one kind and down in the other, by as much."""
    rng = np.random.default_rng(3)
    rows, kinds = [], []
    for i in range(600):
        kind, donor = i % 2, (i // 2) % 2
        x = rng.normal(0, 0.15, 4) + (np.array([4.0, 0, 0, 0]) if kind else np.array([0, 4.0, 0, 0]))
        x[2] += donor * (1.5 if kind else -1.5)
        rows.append((i, "ab"[donor], [float(v) for v in x], 0))
        kinds.append(kind)
    return rows, np.array(kinds)


def gaps(frame, kinds):
    """How far the donors' means lie apart in each kind, and the kinds themselves."""
    got = sorted((r["cell_id"], r["donor"], r["embedding"]) for r in frame.where("cell_id < 600").collect())
    x, donor = np.array([g[2] for g in got]), np.array([g[1] for g in got])
    within = [np.linalg.norm(x[(kinds == k) & (donor == "a")].mean(0) - x[(kinds == k) & (donor == "b")].mean(0)) for k in (0, 1)]
    return max(within), np.linalg.norm(x[kinds == 0].mean(0) - x[kinds == 1].mean(0))


@pytest.mark.parametrize("block_cells", [10_000, 50])
def test_shifts_that_differ_between_kinds(spark, block_cells):
    rows, kinds = simulated()
    odd = [(700, None, [1.0, 2.0, 3.0, 4.0], 7), (701, "a", None, 7), (702, "b", [float("nan"), 0.0, 0.0, 0.0], 7), (None, "a", [1.0, 0.0, 0.0, 0.0], 7), (703, "a", [0.0] * 4, 7)]
    df = spark.createDataFrame([*rows, *odd], SCHEMA)
    assert gaps(df, kinds)[0] > 1.4
    assert gaps(embed.align_donors(df.where("cell_id < 600"), "donor"), kinds)[0] > 1.4  # one shift per donor cannot do it
    moved = donors.align_donors_softly(df, "donor", clusters=4, block_cells=block_cells)
    assert moved.columns == df.columns and moved.count() == df.count()
    within, between = gaps(moved, kinds)
    assert within < 0.3 and between > 4.5
    stayed = {r["cell_id"]: r["embedding"] for r in moved.where("cell_id >= 700 and cell_id <= 702 or cell_id is null").collect()}
    assert stayed[700] == [1.0, 2.0, 3.0, 4.0] and stayed[701] is None and np.isnan(stayed[702][0]) and stayed[None] == [1.0, 0, 0, 0]


def test_empty_table_and_limits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert donors.align_donors_softly(empty, "donor").collect() == []
    with pytest.raises(ValueError):
        donors.align_donors_softly(empty, "donor", clusters=0)


def test_ridge_against_normal_equations(spark):
    rng = np.random.default_rng(5)
    weight, x = rng.random((40, 2)), rng.normal(size=(40, 3))
    donor = rng.integers(0, 4, 40)
    rows = [(c, int(b), float(weight[donor == b, c].sum()), [float(v) for v in weight[donor == b, c] @ x[donor == b]]) for c in range(2) for b in range(4)]
    got = {(r["cluster"], r["donor"]): r["shift"] for r in donors.ridge_shifts(spark.createDataFrame(rows, "cluster int, donor long, n double, s array<double>"), 0.7).collect()}
    design = np.hstack([np.ones((40, 1)), np.eye(4)[donor]])
    for c in range(2):
        left = design.T @ (weight[:, c : c + 1] * design) + 0.7 * np.diag([0, 1, 1, 1, 1])
        want = np.linalg.solve(left, design.T @ (weight[:, c : c + 1] * x))
        for b in range(4):
            assert got[c, b] == pytest.approx(want[1 + b], abs=1e-9)


def test_responsibilities_favour_missing_donors():
    x = np.array([[1.0, 1.0]])
    even = donors._responsibilities(x, np.eye(2), np.zeros(2), 0.1)[1]
    tilted = donors._responsibilities(x, np.eye(2), np.array([0.0, 1.0]), 0.1)[1]
    assert even[0] == pytest.approx([0.5, 0.5]) and tilted[0, 1] > 0.7
