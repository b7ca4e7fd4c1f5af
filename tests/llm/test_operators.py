"""Packing, counting, exact dedup, chat, mixing and quality on hand-made rows and on the smallest tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortframe.llm import chat, exact_dedup, mixing, packing, quality, token_counts
from cohortframe.llm.queries import ORACLES, QUERIES
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "a", "The cat.", "a  b\tc.\n\nd", " x\n", "x\n", "İstanbul ΣΑΣ naïve café ﬁ ǅ K ſ", "x <|endoftext|> y<|startoftext|>z",
    "HEPSİ. İ. İ? İ! Evet, BİRİNCİSİ? NEREYE GİTTİ! Σ. ΣΑΣ, ŉ. ẞ! ǰ: e\u0301. é; İ\u0307.", "it's don't... a.b,c 12 ½² １２", "c\x1cd \x85 e", "éa é क़ 日本語。 テスト 😀!", "end. Start, go; stop: why? yes!", "Word " * 3000,
]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def documents(spark, folder=FOLDER):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


# --- packing ----------------------------------------------------------------------------


def check_packing(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for key, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(by_doc[key], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        for n, r in enumerate(pieces):
            part = ids[n * capacity : (n + 1) * capacity]
            assert (r["start"], r["length"], r["ids_crc32"]) == (n * capacity, len(part), zlib.crc32(part.tobytes()))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in rows)


def test_pack_pieces(spark):
    docs = dict(enumerate(TEXTS))
    df = spark.createDataFrame([(k, t, "clash") for k, t in docs.items()], "doc_id long, text string, piece string")
    rows = packing.pack(df, WORDS, capacity=64, with_ids=True).collect()
    check_packing(rows, docs, 64)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(df.where("false"), WORDS).collect() == []
    twice = packing.pack(df.union(df), WORDS, capacity=64).groupBy("doc_id", "piece").count().select("count").distinct().collect()
    assert [r[0] for r in twice] == [2]


def test_ids_of_random_strings():
    random = np.random.default_rng(7)
    letters = list("aAbZéÉİiIıßẞΣσςŉǅǰﬁ日ё") + ["\u0301", "\u0307", "😀", "1", "½"] + list(".,;:!?'-_#\t\x85\xa0  \n")
    tokenizer, encoder = Tokenizer.from_file(WORDS), packing.TokenIds(WORDS)
    for _ in range(20_000):
        text = "".join(random.choice(letters, size=random.integers(1, 14)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want, text


def test_pack_query(spark):
    number, total = check_packing(QUERIES["op2_best_fit_packing"](spark, FOLDER).collect(), documents(spark), 4096)
    assert number <= -(-total // 4096) + 1


def test_exchange_comes_near_the_bound(spark):
    random = np.random.default_rng(1)
    sizes = [int(x) for x in random.integers(1, 100, 3000)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "row long, length long")
    placed = packing.assign(rows, 100, pieces_each=300).collect()
    assert sorted(r["row"] for r in placed) == list(range(3000))
    fill = Counter()
    for r in placed:
        fill[r["sequence_id"]] += sizes[r["row"]]
    assert max(fill.values()) <= 100
    bound = packing.lower_bound(np.array(sizes), 100)
    assert bound <= len(fill) <= bound * 1.03


@pytest.mark.parametrize("sizes,bound", [([60] * 5, 5), ([50] * 5, 3), ([100], 1), ([67, 67, 34, 34, 34, 34], 4), ([1], 1)])
def test_lower_bound(sizes, bound):
    assert packing.lower_bound(np.array(sizes), 100) == bound


def test_best_fit_is_best_fit_decreasing():
    assert packing.best_fit(np.array([30, 70, 50, 20, 40]), 100).tolist() == [0, 0, 1, 2, 1]


# --- token counts -----------------------------------------------------------------------


@pytest.mark.parametrize("table_docs", [0, 4000])
def test_token_counts(spark, table_docs):
    tokenizer = Tokenizer.from_file(BYTES)
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df.union(df), BYTES, table_docs=table_docs).collect()}
    assert got == {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(TEXTS)}
    assert token_counts.token_counts(df.where("false"), BYTES).collect() == []


def test_token_count_query(spark):
    tokenizer = Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_token_counts"](spark, FOLDER).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    want = {k: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for k, t in documents(spark).items()}
    assert got == {k: (len((t or "").encode()), want[k], want[k] > 512) for k, t in documents(spark).items()}


# --- exact dedup ------------------------------------------------------------------------


@pytest.mark.parametrize("capacity, hot_rows", [(100_000, 1_000), (2, 1_000), (2, 1)])
def test_exact_duplicates(spark, capacity, hot_rows):
    texts = [None, "", "a", "a ", "A", "a", "b\x00", "b", "é", "é", "x" * 100_000, "x" * 100_000]
    rows = [(k, t, 0) for k, t in enumerate(texts)] + [(5, "a", 1), (None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key64 int")
    got = sorted(map(tuple, exact_dedup.exact_duplicates(df, capacity=capacity, hot_rows=hot_rows).collect()), key=repr)
    groups = {}
    for k, t, _ in rows:
        groups.setdefault(t or "", []).append(k)
    want = []
    for k, t, _ in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        want.append((k, keep, len(same), k == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(df.where("false")).collect() == []


def test_owners_chain_different_texts_of_one_key(spark):
    rows = [(k, 7, t, k % 3) for k, t in enumerate(["b", "a", "b", "c", "a", "a"])] + [(9, 8, "a", 0)]
    df = spark.createDataFrame(rows, "id long, key64 long, text string, owner int")
    got = {(r["owner"], r["key64"], r["text"]): r["chain"] for r in exact_dedup._chained(df.repartition("owner"), ["owner"]).collect()}
    want = {}
    for _, key, text, owner in sorted(rows, key=lambda r: r[2]):
        want.setdefault((owner, key, text), sum(1 for o, k, _ in want if (o, k) == (owner, key)))
    assert got == want


def test_directory_reads_keys_again_only_below_overfull_buckets(spark):
    # All keys agree on their first 18 bits, so the buckets split behind the first reading.
    keys = spark.range(64).select(F.shiftleft("id", 40).alias("key"))
    leaves = exact_dedup.directory(keys, 16).collect()
    assert sum(2.0 ** -r["depth"] for r in leaves) == 1.0
    assert max(r["depth"] for r in leaves) == 20


def test_directory_splits_until_nothing_is_overfull(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.directory(keys.union(keys), 300).collect()
    assert sum(2.0 ** -r["depth"] for r in leaves) == 1.0  # the leaves part all keys
    held = Counter()
    for r in keys.collect():
        unsigned = r["key"] % (1 << 64)
        held[next((x["depth"], x["bucket"]) for x in leaves if unsigned >> (64 - x["depth"]) == x["bucket"])] += 1
    assert max(held.values()) <= 300 and sum(held.values()) == 5000


# --- chat -------------------------------------------------------------------------------

CHATS = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<~|im_end|>", "<~~s> [~/INST] <<SYS>> <</SYS>> <<~SYS>>", "a < b [x] ~ <s", "é😀\n\n<|endoftext|>"]


def test_escapes_can_be_undone(spark):
    df = spark.createDataFrame([(t,) for t in CHATS], "t string").select("t", chat.escaped(F.col("t")).alias("e"))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r["back"] == r["t"]
        assert not any(c in r["e"] for c in ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_reply_tree_branches(spark):
    rows = [  # tree, node, parent, role, text, score
        ("t", 1, None, "user", CHATS[1], 1.0), ("t", 2, 1, "assistant", CHATS[2], 0.2), ("t", 3, 1, "assistant", CHATS[4], 0.9),
        ("t", 4, 3, "user", CHATS[3], None), ("t", 5, 4, "assistant", CHATS[6], 0.9), ("t", 6, 2, "us<er\n%0A", None, 2.0),
        ("u", 1, 99, None, "an orphan is a root", None),
    ]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    df = df.union(df.limit(1)).withColumn("leaf", F.lit("clash"))
    done = chat.format_trees(df, "tree", "node", "parent", score="score", branches=None)
    done = done.withColumns({"turns": chat.turns_of(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {(r["tree"], r["rank"]): (r["leaf"], [tuple(t) for t in r["turns"]], r["loss"]) for r in done.collect()}
    by = {(r[0], r[1]): (r[3] or "", r[4] or "") for r in rows}
    assert got == {
        ("t", 1): (6, [by["t", k] for k in (1, 2, 6)], CHATS[2]),
        ("t", 2): (5, [by["t", k] for k in (1, 3, 4, 5)], CHATS[4] + CHATS[6]),
        ("u", 1): (1, [by["u", 1]], ""),
    }
    assert [r["leaf"] for r in chat.format_trees(df, "tree", "node", "parent", score="score").where("tree = 't'").collect()] == [6]
    assert chat.format_trees(df.where("false"), "tree", "node", "parent").collect() == []


def test_rows_without_a_tree_are_one(spark, tmp_path):
    rows = [(None, 0, "user", CHATS[1]), (None, 1, "assistant", CHATS[2]), (0, 0, "user", "a"), (0, 1, "assistant", None), (5, 3, None, "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_trees(chat.with_parents(df, "conv_id", "turn"), "conv_id", "node", "parent")
    assert sorted((r["tree"], r["n_turns"]) for r in done.where("tree is not null").collect()) == [(0, 2), (5, 1)]
    assert [r["n_turns"] for r in done.where("tree is null").collect()] == [2]
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert difference(QUERIES["op8_chat_formatting"](spark, str(tmp_path)), con, ORACLES["op8_chat_formatting"]) is None


def test_long_path_and_circle(spark):
    chain = spark.range(100).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    paths = chat.reply_paths(chain, "tree", "node", "parent").collect()
    assert sorted((r["leaf"], r["node"], r["depth"]) for r in paths) == [(99, k, k) for k in range(100)]
    circle = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 2)], "tree int, node int, parent int")
    with pytest.raises(ValueError, match="circle"):
        chat.reply_paths(circle, "tree", "node", "parent")


# --- mixing -----------------------------------------------------------------------------


def test_mix_reaches_the_weights(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "small").alias("source"), F.lit(9).alias("copy")
    )
    weights = spark.createDataFrame([("big", 1.0), ("small", 2.0), (None, 1.0)], "source string, weight double")
    sizes = mixing.source_sizes(docs)
    rates = {r["source"]: r["rate"] for r in mixing.repetition_rates(sizes, weights).collect()}
    assert rates == pytest.approx({"big": 5000 / 14000, "small": 10000 / 4000, None: 5000 / 2000})
    got = mixing.mix(docs, mixing.repetition_rates(sizes, weights)).toPandas()
    share = got["source"].fillna("none").value_counts(normalize=True)
    assert share.to_dict() == pytest.approx({"small": 0.5, "big": 0.25, "none": 0.25}, abs=0.02)
    copies = got.groupby("doc_id").size()
    small = copies.reindex(got[got["source"] == "small"]["doc_id"].unique())
    assert 1 < small.var() < 4 and not got.duplicated(["doc_id", "copy"]).any()
    again = mixing.mix(docs.repartition(7), mixing.repetition_rates(sizes, weights)).toPandas()
    assert sorted(zip(got["doc_id"], got["copy"], got["shuffle_key"])) == sorted(zip(again["doc_id"], again["copy"], again["shuffle_key"]))


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (3, "c")], "doc_id long, source string")
    rates = spark.createDataFrame([("a", 30.0), ("b", 0.0)], "source string, rate double")
    got = mixing.mix(docs, rates).groupBy("doc_id", "source").count().collect()
    assert len(got) == 1 and got[0]["source"] == "a" and got[0]["count"] % 2 == 0 and got[0]["count"] > 20
    none = mixing.repetition_rates(mixing.source_sizes(docs.where("false")), rates.withColumnRenamed("rate", "weight"))
    assert mixing.mix(docs.where("false"), none).collect() == []


# --- quality ----------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op10_quality"](spark, folder).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 40 and np.mean([p == y for p, y in held]) > 0.93
    assert np.mean([p for p, y in held if y]) > 0.97


def test_quality_edges(spark):
    rows = [(k, "good plain words here" if k % 2 else "BAD!! BAD!! ###", "clash") for k in range(40)]
    rows += [(50, None, ""), (51, "", ""), (52, "good plain words here " * 25_000, ""), (None, "x", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(50, None), (None, 1), (51, 7)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert got[1] > 0.8 and got[0] < 0.2 and got[50] == got[51] and got[52] > 0.5
    nothing = quality.train(docs, labels.where("false"))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.where("false"), nothing).collect() == []
