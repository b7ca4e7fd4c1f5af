import itertools
import random
import re

import pytest

from cohortframe.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def lines_of(text):
    out, line = [], ""
    for k, c in enumerate(text):
        line += c
        if c == "\n" or text[max(0, k - 1) : k + 1] == ". ":
            out.append(line)
            line = ""
    return [*out, line]


def brute(rows, min_words):
    """Every maximal run of equal lines at two places: the later one goes, and of places that overlap what is behind one whole copy."""
    docs = [(key, lines_of(text or "")) for key, text in sorted(rows)]
    docs = [(key, lines[:-1] if lines[-1] == "" else lines) for key, lines in docs]
    ids = {key: [x.strip(BLANK) for x in lines] for key, lines in docs}
    words = {key: [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines] for key, lines in docs}
    gone = {key: set() for key, _ in docs}
    places = {}
    for n, (two, _) in enumerate(docs):
        b = ids[two]
        for j, x in enumerate(b):
            places.setdefault(x, []).append((n, j))
        shifts = {(m, j - i) for j, x in enumerate(b) for m, i in places[x] if (m, i) < (n, j)}
        for m, shift in shifts:
            one, i = docs[m][0], max(0, -shift)
            a, w = ids[one], words[one]
            while i < len(a) and i + shift < len(b):
                size = 0
                while i + size < len(a) and i + shift + size < len(b) and a[i + size] == b[i + shift + size]:
                    size += 1
                upto = list(itertools.accumulate(w[i : i + size]))
                if upto and upto[-1] >= min_words:
                    least = 1 + next(k for k, total in enumerate(upto) if total >= min_words)
                    gone[two].update(range(i + max(shift, least) if m == n else i + shift, i + shift + size))
                i += size + 1
    out = {key: "".join(x for k, x in enumerate(lines) if k not in gone[key]) for key, lines in docs}
    return out | {key: text for key, text in rows if text is None or not gone[key]}


def run(spark, rows, min_words):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, line string, pos string")
    got = line_dedup.dedup_lines(df, min_words=min_words)
    assert got.columns == df.columns
    return {r["doc_id"]: r["text"] for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pick = random.Random(seed)
    pool = [" ".join(pick.choices("abcdefgh", k=pick.randint(1, 4))) + pick.choice([". ", ".\n", "\n"]) for _ in range(30)]
    runs = [[pick.choice(pool) for _ in range(pick.randint(2, 12))] for _ in range(6)]
    rows = []
    for k in range(30):
        parts = []
        for _ in range(pick.randint(1, 5)):
            parts += pick.choice(runs) if pick.random() < 0.5 else [pick.choice(pool)] if pick.random() < 0.6 else [f"own {k} {pick.random()}. "]
        rows.append((k, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a. " * 40), (103, "a. " * 40 + "b"), (104, rows[3][1]), (105, rows[3][1] + "\u0001")]
    assert run(spark, rows, 8) == brute(rows, 8)


def test_one_long_line_and_clean_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows = [
        (5, "Start here. " + passage),
        (1, "Own words first.\nThe end. " + passage + " After it."),
        (2, "The end. Own words first.\nThe end. Nothing else."),
        (9, passage),
        (7, " ".join(f"q{i}" for i in range(100_000))),
    ]
    got = run(spark, rows, 50)
    assert got == {5: "Start here. ", 1: rows[1][1], 2: rows[2][1], 9: "", 7: rows[4][1]}


def test_equal_rows_missing_keys_and_empty_table(spark):
    text = "one two three. four five six. "
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "z " + text)], "doc_id long, text string")
    got = sorted(map(tuple, line_dedup.dedup_lines(df, min_words=4, removed="n").collect()), key=repr)
    assert got == [(1, text, 0), (1, text, 0), (2, "", 2), (None, "z " + text, 0)]
    assert line_dedup.dedup_lines(df.where("false")).collect() == []


def test_words_are_counted_whatever_parts_them(spark):
    tabbed, padded = "\t".join(f"w{k}" for k in range(80)) + "\n", "x" + " " * 60 + "y\n"
    mixed = " \t ".join(f"v{k}" for k in range(30)) + " \x0b\n" + "\r\n" + "  ".join(f"u{k}" for k in range(20)) + "\r\n"
    rows = [(1, tabbed + padded), (2, "own\n" + tabbed), (3, padded), (4, mixed + "a"), (5, "b\n" + mixed), (6, "x\ty. " * 40)]
    want = dict(rows) | {2: "own\n", 5: "b\n", 6: "x\ty. " * 25}
    assert run(spark, rows, 50) == brute(rows, 50) == want


def test_query_against_brute_force(spark):
    from cohortframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows, 50)
    got = QUERIES["op4_line_dedup"](spark, folder).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert sum(r["n_removed"] > 0 for r in got) == sum(want[k] != t for k, t in rows) > 0
