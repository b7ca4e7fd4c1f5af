"""Repeated runs go whole, ends included."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_line_dedup import brute, run  # noqa: E402


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_go_whole(spark, seed):
    pick = random.Random(seed)
    pool = [" ".join([f"l{k}", *pick.choices("abcd", k=pick.randint(0, 5))]) + pick.choice([". ", ".\n", "\n"]) for k in range(60)]
    runs = []
    for _ in range(12):
        a = pick.randint(0, 50)
        runs.append([x for line in pool[a : a + pick.randint(2, 10)] for x in ([line, "\n"] if pick.random() < 0.2 else [line])])
    rows = []
    for k in range(30):
        parts = []
        for r in pick.sample(runs, pick.randint(1, 3)):
            parts += [*r[pick.randint(0, 1) :], *([f"own {k} {pick.random()}. "] if pick.random() < 0.7 else [])]
        rows.append((k, "".join(parts)))
    rows += [(100, rows[4][1]), (101, rows[5][1] + "\n\n")]
    assert run(spark, rows, 12) == brute(rows, 12)


def test_short_ends_and_whole_copies(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n)) + ". "
    three, two = line("a", 30) + line("b", 30) + line("c", 10), line("d", 60) + line("e", 10)
    rows = [(1, three), (2, two), (3, three), (4, two), (5, "Own text. " + two + "More."), (6, line("f", 10) + line("g", 60) + "\n\n"), (7, line("f", 10) + line("g", 60) + "\n\n")]
    want = dict(rows) | {3: "", 4: "", 5: "Own text. More.", 7: ""}
    assert run(spark, rows, 50) == want


def test_a_longer_copy_of_a_later_document(spark):
    line = lambda name, n: " ".join(f"{name}{k}" for k in range(n)) + ". "
    rows = [(1, line("a", 60)), (2, line("a", 60) + line("b", 5)), (3, line("a", 60) + line("b", 5))]
    assert run(spark, rows, 50) == {1: rows[0][1], 2: line("b", 5), 3: ""}
