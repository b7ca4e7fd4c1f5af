"""Near-dedup at a similarity: exact on both sides of it, and nodes that agree on a whole long."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import simhash


def test_both_sides_of_the_similarity(spark):
    random = np.random.default_rng(3)
    word = lambda: f"w{random.integers(0, 10**12)}"
    rows, want = [], {}
    # A text of n shingles and its first m of them: similarity m / n.
    for n, m in [(100, 80)] * 60 + [(5, 4)] * 40 + [(100, 79), (100, 76), (9, 7), (400, 310)] * 15:
        words = [word() for _ in range(n + 4)]
        k = len(rows)
        rows += [(k, " ".join(words)), (k + 1, " ".join(words[: m + 4]))]
        want |= {k: k, k + 1: k if m / n >= 0.8 else k + 1}
    got = dict(map(tuple, simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert all(got[k] == k for k in want if want[k] == k)
    missed = [k for k in want if want[k] != got[k]]
    assert len(missed) <= 3  # of 100 pairs at exactly 0.8


@pytest.mark.parametrize("top", [-1, 1])
def test_nodes_that_agree_on_a_long_are_cut(spark, top):
    entries = spark.range(40).select(F.lit(0).alias("trie"), F.lit(top * (2**62 + 5)).alias("turned"), "id", F.array("id").alias("code"))
    rows = [r["items"] for r in simhash._tasks(entries, 1, 64, 124).collect()]  # begins at 62 bits
    assert max(map(len, rows)) < 40
    met = set()
    for items in rows:
        left, right = ([r["id"] for r in items if r["side"] == k] for k in (0, 1))
        met |= {(min(a, b), max(a, b)) for a in left for b in right or left}
    assert {(a, b) for a in range(40) for b in range(a + 1, 40)} <= met
