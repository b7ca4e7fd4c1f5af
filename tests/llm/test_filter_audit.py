"""The audit of filters: diagrams against counting, and the query against its SQL and odd rows."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortframe.llm import filter_audit as fa


def brute(names, rows):
    """``rows``: part, set of failed filters, flags. Applies every order to every row."""
    out = {}
    for part in {p for p, _, _ in rows}:
        mine = [(fails, flags) for p, fails, flags in rows if p == part]
        shapley = Counter()
        for order in itertools.permutations(names):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[f] += len(gone)
                failing = sum(f in x[0] for x in mine)
                lost = [sum(x[1][k] for x in gone) for k in range(len(mine[0][1]))]
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[0] == {f} for x in mine), *lost]
        for (p, order, step), numbers in out.items():
            if p == part:
                numbers.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_swaps_meet_every_order_once(n):
    places, met = list(range(n)), [tuple(range(n))]
    for k in fa.swaps(n):
        places[k], places[k + 1] = places[k + 1], places[k]
        met.append(tuple(places))
    assert len(met) == len(set(met)) == math.factorial(n)


def test_swapping_keeps_the_function_and_touches_two_levels():
    pick = random.Random(4)
    cells = {m: (pick.randint(1, 3), pick.randint(0, 1)) for m in range(32) if pick.random() < 0.7}
    d = fa.Diagram(5, cells)

    def weight(mask):
        at = 0
        for level, variable in enumerate(d.order):
            at = d.levels[level][at][mask >> variable & 1]
        return d.sums[5][at]

    for level in [0, 3, 1, 2, 2, 0, 3, 1]:
        before, order = [list(x) for x in d.levels], list(d.order)
        d.swap(level)
        assert d.order == order[:level] + [order[level + 1], order[level]] + order[level + 2 :]
        assert all(before[k] == d.levels[k] for k in range(5) if k not in (level, level + 1))
        assert all(len(set(x)) == len(x) for x in d.levels)  # equal subdiagrams are shared
        assert all(weight(m) == cells.get(m, (0, 0)) for m in range(32))


def test_shared_nodes():
    # Independent of the first two variables: one node on each level.
    d = fa.Diagram(3, {m: (2,) if m & 4 else (5,) for m in range(8)})
    assert [len(x) for x in d.levels] == [1, 1, 1]


def test_against_every_order_on_rows(spark):
    pick = random.Random(2)
    rows = [(pick.choice(["x", "y", None]), {f for f in "PQRS" if pick.random() < 0.4}, (pick.random() < 0.5,)) for _ in range(200)]
    rows += [("clean", set(), (True,))]
    df = spark.createDataFrame([(p, *[f in fails for f in "PQRS"], flags[0]) for p, fails, flags in rows], "part string, P boolean, Q boolean, R boolean, S boolean, mask boolean")
    got = fa.audit(df, {f: F.col(f) for f in "PQRS"}, F.col("part"), {"lost": F.col("mask")}).collect()
    want = brute("PQRS", [(p or "", fails, flags) for p, fails, flags in rows])
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_missing_failures_pass_and_too_many_filters(spark):
    df = spark.createDataFrame([("a", None), ("a", True)], "part string, P boolean")
    assert [tuple(r) for r in fa.audit(df, {"P": F.col("P")}, F.col("part")).collect()] == [("a", "P", 1, 1, 1, 0, 1, 1)]
    with pytest.raises(ValueError):
        fa.audit(df, {c: F.col("P") for c in "ABCDEFGH"}, F.col("part"))


def fails_of(rows):
    """Failures of ``(doc_id, text, lang)`` rows, straight from the conditions."""
    blank = "\x20\t\n\x0b\x0c\r"
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    out = []
    for key, text, lang in rows:
        text = text or ""
        words = "".join(" " if c in blank else c for c in text).split(" ")
        words = [w for w in words if w]
        fails = {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
        fails |= {"D"} if any(c in "#$%&*|" for c in text) else set()
        fails |= {"E"} if key is not None and key > first[text] else set()
        out.append((lang or "", fails))
    return out


def documents():
    long = " ".join(f"w{k}" for k in range(120))
    rows = [
        (1, long, "en"), (2, long, "de"), (2, long, "de"), (3, None, "en"), (4, "", None), (5, "", ""), (None, "", "en"), (None, long, "en"),
        (6, "ABC DEF", "en"), (7, "a\x85b c \x0b\x0c d", "en"), (8, "x " * 150, "fr"), (9, "ÄÖÜ É", "fr"), (10, long + " #", "en"),
        (11, "Word\tword\nword\r\n" * 50, "en"), (12, " ".join(f"q{k}" for k in range(200_000)), "en"), (0, "x " * 150, "fr"), (13, "😀 A", "fr"),
    ]
    return rows


def test_odd_documents(spark):
    rows, marks = documents(), {1: (1, 0), 2: (0, 1), 8: (1, 1), 12: (1, None)}
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, id string, good int")
    labels = spark.createDataFrame([(k, *v) for k, v in marks.items()] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    flags = [tuple(int(bool(x)) for x in marks.get(r[0], (0, 0))) for r in rows]
    want = brute("ABCDE", [(*p, f) for p, f in zip(fails_of(rows), flags)])
    got = fa.audit_documents(docs, labels).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_documents(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a", "en")], docs.schema)
    assert fa.audit_documents(one, labels).count() == 600
