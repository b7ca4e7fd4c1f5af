"""The conversation prefix trie against plain dictionaries."""

import hashlib
import random
import zlib

import pytest

from cohortframe.llm import prefix_trie as pt
from cohortframe.llm.common import lookup
from cohortframe.session import materialised


def ordered(rows):
    """conversation -> its turns ``(role, text)`` in order, a missing turn first; rows are ``conv, turn, role, text``."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)
    below = {}
    for prefix in sorted(members, key=len, reverse=True):
        sums = [below[k] for k in children.get(prefix, [])]
        own = (len(members[prefix]) - 1) * len(prefix[-1][1]) if prefix else 0
        below[prefix] = (sum(s[0] for s in sums) or 1, own + sum(s[1] for s in sums))
    out = set()
    for prefix, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(prefix))))
        up = min(members[prefix[:-1]]) if prefix else None
        out.add((min(held), len(prefix), up, len(held), len(children.get(prefix, [])), *below[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def result(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int")


def sample(seed, convs=60):
    pick = random.Random(seed)
    heads = [[(pick.choice("ua"), pick.choice(["hi", "é😀", "", "ok then"])) for _ in range(pick.randint(1, 9))] for _ in range(4)]
    rows = []
    for c in range(convs):
        turns = (pick.choice(heads)[: pick.randint(0, 9)] if pick.random() < 0.8 else []) + [("u", f"own {pick.randint(0, 3)}")] * pick.randint(0, 3)
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 2, 4])
def test_against_dictionaries(spark, block):
    rows = sample(block)
    assert result(pt.prefix_trie(frame(spark, rows), block=block)) == brute(ordered(rows))


def test_long_shared_and_odd_conversations(spark):
    long = [(1, t, "u", f"t{t % 7}") for t in range(300)]
    rows = long + [(2, t, "u", f"t{t % 7}") for t in range(290)] + [(3, t, "u", f"t{t % 7}") for t in range(290)]
    rows += [(4, None, None, None), (4, 0, "", ""), (4, None, "u", "x"), (5, 0, "u", "x"), (5, 0, "u", "x"), (5, 0, "a", None), (None, 0, "u", "t0"), (-7, 0, "u", "t0")]
    rows += [(6, 0, "u:", "1:"), (7, 0, "u", ":1:"), (8, 0, "a", "z" * 100_000), (9, 0, "a", "z" * 100_000)]
    assert result(pt.prefix_trie(frame(spark, rows))) == brute(ordered(rows))


def test_rebuilt_conversations_and_members_without_turns(spark):
    rows = [(c, t, r, x) for c, t, r, x in sample(9, 230) if c < 100 or c > 100 and t < 2]
    convs = ordered(rows)
    turns = materialised(pt.turns_of(frame(spark, rows)))
    heads = pt.with_shared_heads(turns)
    got = result(pt.trie(heads, turns.select("conv").distinct()))
    assert any(not t for t in rebuilt(convs).values())
    assert got == brute(rebuilt(convs))


def test_many_ends_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(pt, "IDS", 16)
    rows = [(c, 0, "u", "same") for c in range(-20, 400)]
    assert result(pt.prefix_trie(frame(spark, rows))) == brute(ordered(rows))


def test_ranges_of_long_conversations(spark, monkeypatch):
    from cohortframe.operators import scan

    rows = [(1, t, "u", f"t{t % 3}") for t in range(200)] + sample(3, 10)
    monkeypatch.setattr(scan, "BLOCK_ROWS", 20)
    monkeypatch.setattr(scan.ordered, "__kwdefaults__", scan.ordered.__kwdefaults__ | {"block_rows": 20})
    monkeypatch.setattr(scan.with_position, "__kwdefaults__", scan.with_position.__kwdefaults__ | {"block_rows": 20})
    assert result(pt.prefix_trie(frame(spark, rows))) == brute(ordered(rows))


def test_empty_table(spark):
    assert result(pt.prefix_trie(frame(spark, [])[["conv_id", "turn", "role", "text"]])) == set()


def test_lookup_of_frequent_keys(spark):
    rows = materialised(spark.createDataFrame([(1 if k % 3 else k, k) for k in range(3000)] + [(None, 1), (5_000_000, 1)], "key long, n long"))
    facts = materialised(spark.range(4000).selectExpr("id as key", "id * 2 as fact"))
    got = sorted(map(tuple, lookup(rows, facts, ["key"]).collect()))
    assert got == sorted((1 if k % 3 else k, k, 2 if k % 3 else 2 * k) for k in range(3000))
