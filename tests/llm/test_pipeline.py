"""Each stage of the pipeline on its own input, against brute force."""

import hashlib
import math
import sys
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from cohortframe.llm import mixing, quality
from cohortframe.session import materialised

sys.path.insert(0, str(Path(__file__).parent))
from test_line_dedup import brute as brute_lines  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialised(stage(spark, out[-1], FOLDER)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == pipeline.COLUMNS and df.dtypes == steps[0].select(*pipeline.COLUMNS).dtypes


def test_quality_keeps_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = quality.train(steps[0], labels.where(~quality.held_out()))
    scores = {r["doc_id"]: r["score"] for r in quality.score(steps[0], model).collect()}
    before, after = texts(steps[0]), texts(steps[1])
    assert after == {k: t for k, t in before.items() if scores[k] >= pipeline.LEAST_QUALITY}
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    assert sum(k in after for k in good) > 0.97 * len(good)


def test_line_dedup(steps):
    before, after = texts(steps[1]), texts(steps[2])
    assert after == brute_lines(sorted(before.items()), 50)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {""}


def test_near_dedup_keeps_one_of_each_group(steps):
    before, after = texts(steps[2]), texts(steps[3])
    assert after.items() <= before.items()
    sets = {k: shingles(t) for k, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    kept = sorted(after)
    assert all(alike(a, b) < 0.8 for n, a in enumerate(kept) for b in kept[n + 1 :])
    for k in before.keys() - after.keys():
        assert any(alike(k, j) >= 0.8 for j in before if j != k)


def test_mixing_repeats_by_the_distribution(spark, steps):
    rows = steps[3].collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    weight = {s: math.sqrt(n) for s, n in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / n if n else 0 for s, n in size.items()}
    want = Counter()
    for r in rows:
        u = int(hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, math.exp(-rate[r["source"]])
        below = p
        while below <= u:
            k += 1
            p *= rate[r["source"]] / k
            below += p
        want[r["doc_id"]] += k
    assert Counter(r["doc_id"] for r in steps[4].collect()) == +want
    assert mixing.TAIL >= 12


def test_packing_takes_every_copy(steps):
    copies = Counter(r["doc_id"] for r in steps[4].select("doc_id").collect())
    rows = steps[5].collect()
    pieces = Counter((r["doc_id"], r["piece"]) for r in rows)
    assert all(n == copies[k] for (k, _), n in pieces.items()) and {k for k, _ in pieces} == set(copies)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_run_is_all_stages(spark, steps):
    got = pipeline.run(spark, FOLDER)
    assert Counter(map(tuple, got.select("doc_id", "piece", "ids_crc32").collect())) == Counter(
        map(tuple, steps[5].select("doc_id", "piece", "ids_crc32").collect())
    )


def odd_rows(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (None, words("a", 40), "en", "s1", 5, 1), (1, words("b", 40), "en", "s1", 5, 2), (1, words("b", 40), "en", "s1", 5, 2),
        (2, words("a", 40) + " x", "en", None, 5, 3), (None, words("c", 60), None, "s1", None, 4), (None, words("c", 60), None, "s1", None, 4),
        (3, None, "de", "s2", None, 5), (None, "", "de", "s2", 0, 6), (4, words("d", 50) + ".\n" + words("e", 20), "fr", "s2", 1, 7),
        (5, words("d", 50) + ".\nown", "fr", "s2", 1, 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, code int")


def test_near_dedup_with_missing_ids_and_repeated_rows(spark):
    got = pipeline.drop_near_duplicates(spark, odd_rows(spark), FOLDER)
    assert got.columns == pipeline.COLUMNS
    rows = got.collect()
    # Of a pair the id that is there stays; of equal rows one; of empty texts the smallest id.
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in rows) == [(0, "c0"), (1, "b0"), (2, "a0"), (3, ""), (4, "d0"), (5, "d0")]


def test_other_stages_with_missing_ids_and_repeated_rows(spark):
    docs = odd_rows(spark)
    kept = pipeline.keep_quality(spark, docs, FOLDER)
    assert kept.columns == pipeline.COLUMNS and kept.count() <= 10
    lines = pipeline.drop_repeated_lines(spark, docs, FOLDER)
    texts = Counter((r["doc_id"], r["text"]) for r in lines.collect())
    assert lines.columns == pipeline.COLUMNS and sum(texts.values()) == 10
    assert texts[5, "own"] == 1 and texts[None, docs.collect()[0]["text"]] == 1 and texts[3, None] == 1
    mixed = pipeline.mix_sources(spark, docs, FOLDER).collect()
    copies = Counter((r["doc_id"], r["text"]) for r in mixed)
    assert all(n % 2 == 0 for (k, _), n in copies.items() if k == 1)  # the two equal rows are repeated alike
    packed = Counter(r["doc_id"] for r in pipeline.pack_sequences(spark, docs, FOLDER).collect())
    assert packed == {None: 4, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_an_empty_table(spark, stage):
    empty = odd_rows(spark).where("false")
    assert pipeline.STAGES[stage][1](spark, empty, FOLDER).collect() == []
