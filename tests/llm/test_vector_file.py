"""Exact search by vector-approximation files against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import vector_file as vf
from cohortframe.session import materialised


def brute(rows, k, step=50):
    """Each query row's best ``k`` of all other rows, as a sorted list of ``query_id, rank, vec_id, score``."""
    good = [(key, [math.floor(256 * c) for c in v]) for key, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (q, x) in enumerate(good):
        if q is not None and q % step == 0:
            scored = [(sum(a * b for a, b in zip(x, y)), key) for m, (key, y) in enumerate(good) if m != n and len(x) == len(y)]
            scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(q, r, key, score) for r, (score, key) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def run(spark, rows, k=5, step=50, **kw):
    df = spark.createDataFrame([(key, v and [c if c is None else float(c) for c in v], "x", 1) for key, v in rows], "vec_id long, embedding array<double>, cid string, q int")
    got = vf.top_k(df, F.col("vec_id") % step == 0, k=k, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("block, cells", [(vf.BLOCK, vf.CELLS), (7, 4), (40, 2)])
def test_against_all_products(spark, monkeypatch, block, cells):
    monkeypatch.setattr(vf, "QUERIES", 16)
    random = np.random.default_rng(1)
    rows = [(k, random.normal(size=8).tolist()) for k in range(150)]
    rows += [(k, (np.round(random.normal(size=8)) / 4).tolist()) for k in range(150, 260)]  # many ties
    assert run(spark, rows, step=10, block=block, cells=cells) == brute(rows, 5, 10)


def test_copies_ties_and_odd_rows(spark):
    random = np.random.default_rng(2)
    base = random.normal(size=4).tolist()
    rows = [(k, base) for k in range(100, 140)] + [(k, random.normal(size=4).tolist()) for k in range(30)]
    rows += [(0, base), (0, base), (0, base), (50, base), (None, base), (None, [9.0, 9, 9, 9])]
    rows += [(200, None), (201, []), (202, [1.0, None, 0, 0]), (203, [float("nan")] * 4), (204, [float("-inf")] * 4), (250, [0.0] * 4), (300, [-0.001, 0.999, 1 / 256, -1 / 256])]
    rows += [(350, [1.0, 2.0]), (351, [3.0, 4.0]), (400, [1.0] * 300), (450, [1e5, -1e5, 3.0, 0.5]), (451, [1e300, 0, 0, 0])]
    rows.remove((451, [1e300, 0, 0, 0]))  # takes no part, see below
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, [*rows, (451, [1e300, 0, 0, 0])]) == brute(rows, 5)


def test_bounds_hold_for_rows_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(vf, "SAMPLE", 5)
    random = np.random.default_rng(3)
    rows = [(k, (random.normal(size=5) * random.choice([0.01, 1, 100])).tolist()) for k in range(200)]
    assert run(spark, rows, k=3, block=20) == brute(rows, 3)


def test_fewer_rows_than_asked_for(spark):
    rows = [(0, [1.0, 0]), (1, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows, 5) == [(0, 1, 1, 256 * 128)]
    assert run(spark, rows[:1]) == [] and run(spark, []) == [] and run(spark, rows[1:]) == []


def test_most_vectors_are_not_read(spark):
    random = np.random.default_rng(4)
    x = (random.normal(size=(4000, 32)) / math.sqrt(32) * 256).astype(int).astype("<i4")
    classes = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(x)], "cid long, ints binary")
    edges, least, most = vf.cuts(classes, 32)
    codes = vf._codes(x, edges)
    at = np.arange(32)
    assert (least[at, codes] <= x).all() and (x <= most[at, codes]).all()
    q = x[:20].astype(float)
    middle, spread = q @ (least + most)[at, codes].T, np.abs(q) @ (most - least)[at, codes].T
    assert (middle - spread <= 2 * q @ x.T).all() and (2 * q @ x.T <= middle + spread).all()
    passed = middle + spread >= np.partition(middle - spread, -6, axis=1)[:, -6][:, None]
    assert passed.sum(1).mean() < 0.02 * len(x)


def test_blocks_are_not_broadcast(spark):
    """What is spelled out for every pair of blocks is shuffled, not sent through the driver, though the tables look small."""
    file = materialised(spark.createDataFrame([(k, b"c", b"d", b"e") for k in range(5)], "first long, cids binary, codes binary, exact binary"))
    listed = materialised(spark.createDataFrame([(k, b"n", b"x%d" % k) for k in range(3)], "part int, numbers binary, x binary"))
    pairs = vf._pairs(file, listed, 5, 3)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = sorted(bytes(r["x"]) for r in pairs.collect())
    assert found == sorted(b"x%d" % k for k in range(3) for _ in range(5))
