from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from tracewell.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    """The base kinds straight from their patterns."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4000:]) <= 255 and not p[:-4000].strip("0") for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def base(text):
    return [s for s in pii.find(text or "") if s[1] < 4]


CASES = [
    "", " ", "a@b.c", "a@b", "a@b.c@d.e", "x a.b+c%d@e-f.gh.ij. next", "@a.b", "a@@b.c", "é@b.c", "aé.b@c.d.é",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.255", "0001.2.3.4", "1..2.3.4.5", "12.3.4", "99999999999999999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111x", "4111  111111111111", "41111111111111111111111", "79927398713",
    "+1 (555) 123-4567", "+1", "+12", "+1--------", "++49 30 1234567 8", "+1(2)3456789012345678", "+1 234 567 8901+1 234 567 8901",
    "1.2.3.4+1 234 567 8901@a.b", "٣٤@a.b", "x" * 5000 + "@" + "y." * 50 + "z", "1" * 300, "1 " * 300, "+1" + " " * 300,
    "0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "255", "9" * 5000 + ".1.1.1", "4" + "0" * 6000, "+" + "1" * 6000, "a@b." + "1" * 6000,
    "IBAN DE" + "1" * 6000, "account no " + "2" * 6000,
]


def test_base_kinds_equal_their_patterns():
    rng = random.Random(1)
    alphabet = "ab1234567890.@+- ()%é:/"
    for text in CASES + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(4000)] + ["".join(rng.choices("0123456789 .-+", k=80)) for _ in range(2000)]:
        assert base(text) == brute(text), text


def test_cues_add_spans():
    text = "see https://bob:pw@host/x and mailto:amy@localhost; IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; IBAN DE00 1234 5678 9012 34"
    found = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.find(text)]
    assert found == [("login", "bob:pw"), ("login", "amy"), ("iban", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]


def test_masking():
    assert pii.masked(None) is None and pii.masked("plain") == "plain"
    assert pii.masked("mail a@b.c, call +1 234 567 8901.") == "mail <EMAIL>, call <PHONE>."
    assert pii.masked("mailto:a@b.c") == "mailto:<EMAIL>"
    for text in CASES:
        assert not [s for s in brute(pii.masked(text)) if s[1] == 0]


def test_query_equals_brute_force(spark, sf):
    rows = pii.op4_pii(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want} <= set(r["spans"].split(","))  or not want


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string, n_chars bigint, spans string, n_email int"
    rows = [(1, None, None, None, "x", 1), (1, "", "en", 0, None, None), (None, "a@b.c " * 20000, None, 120000, "x", 2), (None, "a@b.c " * 20000, None, 120000, "x", 2)]
    docs = spark.createDataFrame(rows, schema)
    out = sorted((r["n_email"], r["doc_id"] or 0) for r in pii.pii_spans(docs).collect())
    assert out == [(0, 1), (0, 1), (20000, 0), (20000, 0)]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.where(F.col("text").contains("@")).count() == 0
    assert sorted((r["n_chars"] is None, r["n_chars"] or 0) for r in clean.collect()) == [(False, 0), (False, 160000), (False, 160000), (True, 0)]
    assert pii.pii_spans(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0
