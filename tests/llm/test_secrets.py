import hashlib
import re

from cohortframe.llm import secrets
from cohortframe.session import new_folder

KEY = "A1b2C3d4E5f6"
TEXTS = [
    None,
    "",
    "nothing",
    f'Token = "{KEY}" PASSWORD:\'{KEY}\' api-key={KEY} apiKEY  :  {KEY} api_key={KEY[:-1]}',
    f"token=secret:{KEY}{KEY} secret={KEY}",  # the first match is too short, but takes its text
    f"paſſword={KEY} toKen={KEY}",  # only ASCII letters fold
    "AKIA" + "Q" * 14 + " AKIA" + "Q" * 13 + " xAKIAAKIA" + "7" * 20 + "y akia" + "q" * 20,
    "0123456789abcdef 0123456789abcde " + "f" * 40 + "g" + "A" * 20 + "é" + "0" * 16,
    f"é😀 token={'ab12' * 5} AKIA{'Z' * 16}",
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END x ghp_" + "w" * 36 + " https://user:pass@host.example",
]


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        out += [(m.start(), 0, m.end(), "assign")] * (len(m[2]) >= 12)
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def want(text):
    spans = base_spans(text)
    numbers = tuple(sum(s[3] == k for s in spans) for k in ("assign", "access", "hex"))
    return *numbers, hashlib.sha256(",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans).encode()).hexdigest()


def check(got, docs):
    assert len(got) == len(docs)
    for r in got:
        text = docs[r["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == want(text)
        base = [f"{s[3]}:{s[0]}:{s[2]}" for s in base_spans(text)]
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex")] == base


def test_spans(spark):
    docs = dict(enumerate(TEXTS))
    rows = spark.createDataFrame([(k, t, "clash") for k, t in docs.items()], "doc_id long, text string, blob string")
    ledger = new_folder(spark)
    secrets.update(rows, ledger, first=True)
    got = secrets.digests(rows, ledger, "doc_id").collect()
    check(got, docs)
    extra = next(r["spans"] for r in got if r["doc_id"] == 9)
    assert [s.split(":")[0] for s in extra.split(",")] == ["private_key", "code_host", "url_password"]


def test_ledger_scans_each_blob_and_rule_once(spark):
    ledger = new_folder(spark)
    rows = spark.createDataFrame([("a", TEXTS[3]), ("b", TEXTS[3]), ("b", TEXTS[6]), ("c", None)], "path string, text string")
    first = secrets.scan(rows, ledger, "path", rules=secrets.BASE, first=True)
    assert spark.read.parquet(ledger).count() == 3
    n = {r["path"]: r["count"] for r in first.groupBy("path").count().collect()}
    assert n == {"a": len(base_spans(TEXTS[3])), "b": len(base_spans(TEXTS[3])) + len(base_spans(TEXTS[6]))} == {"a": 3, "b": 6}
    more = rows.union(spark.createDataFrame([("d", TEXTS[8])], rows.schema))
    again = secrets.scan(more, ledger, "path", rules=secrets.BASE)
    assert spark.read.parquet(ledger).count() == 3 + 1  # one new blob, scanned once
    assert again.where("path = 'd'").count() == len(base_spans(TEXTS[8]))
    newer = secrets.Rule("hex", 2, r"[0-9a-f]{20,}")
    found = secrets.scan(more, ledger, "path", rules=[newer])
    assert spark.read.parquet(ledger).count() == 4 + 4  # all blobs, by the new version alone
    assert {r["kind"] for r in found.collect()} <= {"hex"}
    mixed = secrets.scan(more.union(spark.createDataFrame([("e", TEXTS[7])], rows.schema)), ledger, "path", rules=[*secrets.BASE, newer])
    new = spark.read.parquet(ledger).collect()
    assert len(new) == 8 + 1 and sum(set(r["rules"]) == {"assign:1", "access:1", "hex:1", "hex:2"} for r in new) == 1
    assert mixed.where("path = 'e' and kind = 'hex'").count() == 3
    secrets.update(more, ledger, rules=[*secrets.BASE, newer])
    assert spark.read.parquet(ledger).count() == 9  # nothing is new


def test_missing_and_shared_keys(spark):
    rows = [(None, f"token={KEY}"), (1, f"token={KEY}"), (1, "nothing here"), (None, None), (2, f"token={KEY}"), (2, f"token={KEY}")]
    df, ledger = spark.createDataFrame(rows, "doc_id long, text string"), new_folder(spark)
    secrets.update(df, ledger, first=True)
    got = sorted(((r["doc_id"], r["n_assign"], r["base_sha256"]) for r in secrets.digests(df, ledger, "doc_id").collect()), key=repr)
    assert got == sorted(((k, want(t)[0], want(t)[3]) for k, t in rows), key=repr)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    ledger = new_folder(spark)
    assert secrets.scan(rows, ledger, "doc_id", first=True).collect() == []
    assert secrets.digests(rows, ledger, "doc_id").collect() == []


def test_query_against_brute_force(spark):
    from cohortframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op3_secret_scan"](spark, folder).collect()
    check(got, docs)
    assert sum(r["n_hex"] for r in got) > 0
