"""Near-dedup at a similarity: what is moved per text does not grow with the table, and crowded nodes and large classes lose nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortframe.llm import simhash


def codes_of(spark, values):
    rows = [(k, [int(x) for x in v.view(np.int64)]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, code array<long>")


def entries_of(groups, longs):
    return np.concatenate([np.frombuffer(r["data"], simhash._entry_type(longs)) for r in groups.collect()])


def test_entries_per_text_do_not_grow(spark):
    random = np.random.default_rng(5)
    moved = []
    for n in (200, 3_200):
        values = random.integers(0, 1 << 63, (n, simhash.LONGS), dtype=np.uint64) << np.uint64(1)
        moved.append(len(entries_of(simhash._groups(codes_of(spark, values), n, 0.8, 32, simhash.CARRIED), simhash.CARRIED)) / n)
    assert moved == [moved[0]] * 2
    # For a table of any size: nodes stay bounded, and tries grow with a small power of it.
    for n in (10**6, 10**8, 10**10):
        bits, tries = simhash.shape(n, 0.8)
        assert n / 2**bits <= simhash.NODE and tries <= 60 * max(1, n / 2**22) ** 0.3


def test_places_use_each_bit_once_a_lap():
    at = simhash.places(14, 100)
    assert all(len(set(row)) == 14 for row in at.tolist())
    assert len({tuple(sorted(row)) for row in at.tolist()}) == 100
    lap = 512 // 14
    assert len(set(at[:lap].ravel().tolist())) == lap * 14


def test_crowded_nodes_are_cut(spark):
    random = np.random.default_rng(6)
    base = random.integers(0, 1 << 63, simhash.LONGS, dtype=np.uint64)
    values = [base ^ (np.uint64(1) << np.arange(k, k + 8, dtype=np.uint64)) for k in range(24)]
    codes = codes_of(spark, values)
    groups = simhash._groups(codes, len(values), 0.8, 5, simhash.CARRIED)
    rows = groups.collect()
    entries = np.concatenate([np.frombuffer(r["data"], simhash._entry_type(simhash.CARRIED)) for r in rows])
    met = set()
    kinds = list(zip(entries["node"].tolist(), (entries["meet"] >> 1).tolist(), (entries["meet"] & 1).tolist(), entries["id"].tolist()))
    for group in {k[:2] for k in kinds}:
        left, right = ([k[3] for k in kinds if k[:2] == group and k[2] == side] for side in (0, 1))
        assert len(left) + len(right) < 24
        met |= {(min(a, b), max(a, b)) for a in left for b in right or left}
    assert {(a, b) for a in range(24) for b in range(a + 1, 24)} <= met
    linked = groups.mapInArrow(simhash._candidates(63), "a long, b long")
    found = {r["node"]: r["component"] for r in simhash.components(linked).collect()}
    assert found == {k: 0 for k in range(24)}


@pytest.mark.parametrize("pairs", [2 * simhash.PAIRS, 9])
def test_large_classes_are_told_apart(spark, pairs):
    """Texts that are all candidates of each other, in four groups of which each is near-duplicates."""
    random = np.random.default_rng(7)
    common = [f"c{random.integers(0, 10**9)}" for _ in range(200)]
    rows = []
    for g in range(4):
        own = common[:160] + [f"g{random.integers(0, 10**9)}" for _ in range(60)]
        for _ in range(9):
            changed = list(own)
            changed[int(random.integers(0, len(own)))] = f"x{random.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(changed)))
    sets = [simhash.shingle_set(t.encode(), 5) for _, t in rows]
    far = len(np.intersect1d(sets[0], sets[9])) / len(np.union1d(sets[0], sets[9]))
    assert 0.5 < far < 0.7
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, simhash.similar(docs, pairs=pairs).collect()))
    assert got == {k: k // 9 * 9 for k, _ in rows}


def test_filter_keeps_all_that_is_wanted(spark):
    rows = spark.range(0, 4_000, 2, numPartitions=3)
    wanted = rows.where("id % 40 = 0")
    kept = {r[0] for r in rows.mapInArrow(simhash._only(wanted.select(F.col("id")), 100), "id long").collect()}
    assert set(range(0, 4_000, 40)) <= kept and len(kept) < 1_000


def test_rows_that_stay_are_not_moved(spark):
    """One row of each class, though only what may go is joined; rows that share a key or have none are told apart."""
    random = np.random.default_rng(8)
    texts = [" ".join(f"w{random.integers(0, 10**9)}" for _ in range(30)) for _ in range(60)]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(5, texts[5]), (None, texts[7]), (200, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.one_of_each(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows[:60]))
    joins = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in joins and joins.count("LeftAnti") == 1
