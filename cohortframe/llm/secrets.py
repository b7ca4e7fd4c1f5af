"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is a blob, named by the SHA-256 of its content. The ledger, a table in a
shared folder, says which blobs have been scanned by which version of which rule, and what was
found. A scan takes the blobs the ledger lacks, once each however many paths hold them, appends
what it finds, and joins the findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortframe.session import materialised, shuffle_partitions

from .common import lookup, text_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; one counts if its ``group`` is ``least`` long.

    A text without any of the lower-case ``hints`` cannot match; no hints: it always may.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()
    ignore_case: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The three base kinds, in the order in which they are listed.
ASSIGN = Rule(
    "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12,
    ("password", "passwd", "secret", "token", "apikey", "api_key"), True,
)
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",))
# A run that is long enough is found whole, and a shorter one holds no match: the same as all runs, then dropped.
HEX = Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16)
BASE = (ASSIGN, ACCESS, HEX)
# Forms of well-known credentials.
EXTRA = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*", 0, 1, ("-----begin ",)),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("url_password", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@[A-Za-z0-9.-]+", 0, 1, ("://",)),
)
RULES = (*BASE, *EXTRA)

_LEDGER = "blob binary, rules array<string>, found array<struct<kind:string,start:bigint,end:bigint>>"
#: A run adds one file to the ledger for so many shuffle partitions: its rows are short, its runs many.
FILES = 16


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``blob, rules, found`` for each of the blobs ``blob, text, wanted``: rule versions applied, and their spans.

    ``wanted`` names the rule versions that the blob has to be scanned by. Offsets count code points; the end is exclusive.
    """
    rules = tuple(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans_of(text: str, wanted: list[str], compiled: list[tuple[Rule, re.Pattern]]) -> list[dict]:
        low, found = text.lower(), []
        for rule, pattern in compiled:
            if rule.name in wanted and (not rule.hints or any(h in low for h in rule.hints)):
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found.append({"kind": rule.kind, "start": m.start(), "end": m.end()})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        for batch in batches:
            spans = [spans_of(t.as_py(), w.as_py(), compiled) for t, w in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, kind)], names=["blob", "rules", "found"])

    return blobs.select("blob", "text", "wanted").mapInArrow(run, _LEDGER)


def versions_of(rows: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``path, blob`` of each row; a missing text is an empty one."""
    return rows.select(F.col(path).alias("path"), F.unhex(F.sha2(text_of(text), 256)).alias("blob"))


def update(rows: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES, first: bool = False) -> None:
    """Scan what the ledger lacks and append it: each blob once, by all the rule versions that it has not seen.

    ``first`` says that the folder ``ledger`` holds nothing yet. Otherwise names of blobs are held against the
    ledger before any text is moved; what is new is usually little.
    """
    spark = rows.sparkSession
    names = F.array(*[F.lit(r.name) for r in rules])
    todo = rows.select(F.unhex(F.sha2(text_of(text), 256)).alias("blob"), text_of(text).alias("text"))
    if first:
        todo = todo.withColumn("wanted", names)
    else:
        seen = spark.read.schema(_LEDGER).parquet(ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        lacks = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("wanted")
        new = todo.select("blob").distinct().join(seen, "blob", "left").select("blob", lacks).where(F.size("wanted") > 0)
        todo = todo.join(materialised(new), "blob")
    scanned = scan_blobs(todo.distinct(), rules).repartition(max(1, shuffle_partitions(spark) // FILES))
    scanned.write.mode("append").parquet(ledger)


def spans_of_blobs(rows: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``blob, spans``: what the ledger holds of these rule versions, each span once, by start and then by the place of its kind."""
    found = rows.sparkSession.read.schema(_LEDGER).parquet(ledger).where(F.size("found") > 0)
    wanted = F.lit(False)
    for rule in rules:
        wanted = wanted | ((F.col("s.kind") == rule.kind) & F.array_contains("rules", rule.name))
    found = found.select("blob", "rules", F.explode("found").alias("s")).where(wanted)
    places = {r.kind: k for k, r in reversed([*enumerate(rules)])}
    place = F.create_map(*[F.lit(x) for item in places.items() for x in item])
    span = F.struct("s.start", place[F.col("s.kind")].alias("k"), "s.end", "s.kind")
    return found.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("spans"))  # the spans of one text


def scan(rows: DataFrame, ledger: str, path: str, text: str = "text", rules: Sequence[Rule] = RULES, first: bool = False) -> DataFrame:
    """Scan what the ledger lacks, append to it, and return ``path, kind, start, end``, a span a row.

    ``rows`` are versions: a path may occur often, and each of its contents is scanned. Only pairs of
    blob and rule version that the ledger lacks are scanned, and no blob twice. A missing path stays
    missing; copies of a row give copies of its findings; an empty table gives none. Other columns
    are left out.
    """
    update(rows, ledger, text, rules, first)
    held = lookup(materialised(versions_of(rows, path, text)), materialised(spans_of_blobs(rows, ledger, rules)), ["blob"])
    return held.select("path", F.explode("spans").alias("s")).select("path", "s.kind", "s.start", "s.end")


def digests(rows: DataFrame, ledger: str, key: str, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per row of ``rows``: numbers of base spans, the hash of their list, and all spans.

    Spans are written ``kind:start:end``, by start and then by the place of their kind in ``rules``. Each row
    gets the spans of its own text, whatever its key: missing and shared keys make no difference.
    """
    written = lambda xs: F.array_join(
        F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["k"] < len(BASE))
    number = lambda kind: F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    held = lookup(materialised(versions_of(rows, key, text)), materialised(spans_of_blobs(rows, ledger, rules)), ["blob"], how="left")
    return held.select(
        F.col("path").alias(key),
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(F.coalesce(written(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(written(F.col("spans")), F.lit("")).alias("spans"),
    )
