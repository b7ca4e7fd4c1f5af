import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortframe.llm import simhash


def plain_print(text, words=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, budget=4):
    """doc -> smallest doc reachable."""
    docs = sorted(prints)
    label = {d: d for d in docs}
    changed = True
    near = [(a, b) for a in docs for b in docs if a < b and (prints[a] ^ prints[b]).bit_count() <= budget]
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


TEXTS = [None, "", " \t\n", "One", "one two", "A b c d", "a B c d e f g", "x\x0by\x0cz w v", "é È é ß a b c", "same same same same same same"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode(), 4) == plain_print(text)


def test_traverse_finds_all_pairs():
    random = np.random.default_rng(0)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    noisy = [b ^ np.bitwise_or.reduce(np.uint64(1) << random.integers(0, 64, 3).astype(np.uint64)) for b in base for _ in range(4)]
    values = np.unique(np.array([*base, *noisy], np.uint64))
    parts = list(simhash.traverse(values, np.zeros(len(values), int), np.array([0]), np.array([0]), 4))
    i, j = (np.concatenate(x) for x in zip(*parts))
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 4}
    assert {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


@pytest.mark.parametrize("pairs", [simhash.PAIRS, 16])
def test_links_connect_what_is_near(spark, pairs):
    random = np.random.default_rng(1)
    prints = []
    for b in random.integers(0, 1 << 63, 6):
        prints.append(int(b))
        for _ in range(12):  # chains of small steps, so that components are wider than the budget
            prints.append(prints[-1] ^ sum(1 << int(k) for k in set(random.integers(0, 64, 4))))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(s,) for s in signed], "fingerprint long")
    got = simhash.components(simhash.links(rows, 4, pairs)).collect()
    want = plain_components(dict(zip(signed, prints)))
    linked = {r["node"]: r["component"] for r in got}
    groups = {}
    for s, g in want.items():
        groups.setdefault(g, set()).add(s)
    assert {s: min(groups[g]) for s, g in want.items() if len(groups[g]) > 1} == linked


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [*TEXTS, long, long.replace("w150 ", "x "), long.upper(), "other " * 3 + long[::-1], long]
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    prints = {k: plain_print(t) for k, t, _ in rows}
    want = plain_components(prints)
    assert sorted(map(tuple, got)) == sorted((k, f"{prints[k]:016x}", want[k]) for k in [*prints, 0])


@pytest.mark.parametrize("pairs", [simhash.PAIRS, 64])
def test_similar_sets(spark, pairs):
    random = np.random.default_rng(2)
    rows, base = [], []
    for g in range(12):
        words = [f"g{g}w{random.integers(0, 10**6)}" for _ in range(400)]
        base.append(words)
        for c in range(4):  # four changed words: about 0.9
            changed = list(words)
            for k in random.choice(400, 4, replace=False) if c else []:
                changed[k] = f"x{random.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(changed)))
    for g in range(12):  # half of the words are others: far below 0.8
        rows.append((len(rows), " ".join(base[g][:200] + [f"y{random.integers(0, 10**6)}" for _ in range(200)])))
    rows += [(100, ""), (101, None), (102, "one"), (103, "one"), (104, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, simhash.similar(docs, pairs=pairs).collect()))
    want = {k: k // 4 * 4 if k < 48 else k for k, _ in rows} | {101: 100, 103: 102}
    assert got == want


def test_similar_of_empty_table(spark):
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []


def test_query_against_brute_force(spark):
    from cohortframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: plain_print(r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    want = plain_components(docs)
    got = QUERIES["op6_simhash"](spark, folder).select("doc_id", F.conv("fingerprint", 16, 10), "component_id").collect()
    assert {(r[0], int(r[1]), r[2]) for r in got} == {(d, p, want[d]) for d, p in docs.items()}
