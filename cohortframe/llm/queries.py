"""The queries of the operators over the driver tables, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortframe.session import materialised, new_folder

from . import audit_queries, search_queries, trie_queries  # noqa: F401  they register their queries
from . import chat, cover_tree, exact_dedup, line_dedup, mixing, packing, quality, secrets, simhash, token_counts
from .common import table
from .registry import ORACLES, QUERIES, query  # noqa: F401


@query(
    "op1_mix_sources",
    f"""
    WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
    rates AS (
        SELECT source, CASE WHEN size > 0 THEN
            pow(size, 0.5) / (SELECT sum(pow(size, 0.5)) FROM sizes) * (SELECT sum(size) FROM sizes) / size ELSE 0 END AS rate
        FROM sizes
    ),
    k AS (SELECT source, rate, unnest(range(0, ceil(rate + {mixing.TAIL} * sqrt(rate) + {mixing.TAIL})::BIGINT + 1)) AS k FROM rates),
    p AS (
        SELECT source, rate, k, CASE WHEN rate = 0 THEN (k = 0)::INT::DOUBLE ELSE exp(
            CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - rate - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END)
            OVER (PARTITION BY source ORDER BY k)) END AS p FROM k
    ),
    steps AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM p),
    drawn AS (
        SELECT doc_id, text, lang, source, n_chars,
            ('0x' || left(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT / pow(2, 52) AS u FROM documents
    ),
    counted AS (
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n
        FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.below <= d.u GROUP BY ALL
    ),
    copies AS (SELECT * EXCLUDE n, unnest(range(0, n))::INT AS copy FROM counted)
    SELECT *, ('0x' || left(md5('mix-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 13))::BIGINT / pow(2, 52)
        AS shuffle_key FROM copies
    """,
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def mixed(docs: DataFrame) -> DataFrame:
    """Sources weighted by the square root of their characters, the whole keeping its size."""
    sizes = mixing.source_sizes(docs, size=F.length(F.coalesce("text", F.lit(""))))
    sizes = materialised(sizes)
    return mixing.mix(docs, mixing.repetition_rates(sizes, mixing.tempered(sizes)))


@query("op2_best_fit_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_secret_scan")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), new_folder(spark)
    secrets.update(docs, ledger, first=True)
    return secrets.digests(docs, ledger, "doc_id")


@query("op4_line_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed="n_removed").withColumn("n_chars", F.length("text").cast("long"))


@query("op5_embedding_near_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op6_simhash")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    """,
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op8_chat_formatting",
    f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), formed AS (
        SELECT *, regexp_replace(
            text, '([<\\[])(~*(?:{chat.CONTROL}))', '\\1~\\2', 'g') AS safe
        FROM rows
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum({len(chat.START)} + length(role) + {len(chat.MIDDLE)} + length(safe) + {len(chat.END)})::BIGINT AS formatted_chars
    FROM formed GROUP BY conv_id
    """,
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, id AS turn, element_at(array('user', 'assistant'), int(id) + 1) AS role, '' AS text FROM range(2)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra.withColumn("text", F.lit(probe)))
    done = chat.format_trees(chat.with_parents(rows, "conv_id", "turn"), "conv_id", "node", "parent")
    read = done.withColumns(
        {"turns": chat.turns_of(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))}
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op9_token_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.drop("text").withColumn("over_limit", F.col("n_tokens") > 512)


@query("op10_quality")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out()))
    scored = quality.score(docs, model).drop("text")
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
