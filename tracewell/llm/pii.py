"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and stops at anchors: at-signs, plus
signs, digits, schemes (`mailto:`, `https://` ...) and identifier cues (`IBAN`, `account no` ...).
At an anchor a deterministic local parser expands to the left and right, sets the
boundaries and validates (labels of a domain, parts of an address, Luhn, IBAN's remainder). Each parser
reads its own neighbourhood only, so the cost is linear in the text.

Kinds, in this order: email, ip, card, phone (leftmost, non-overlapping per kind, a failing candidate is
dropped without another try), then what cues add: `login` (user part of an address after a scheme),
`iban`, `account`. Spans count code points, end exclusive.

Null text counts as empty; both have no spans. Repeated rows are treated one by one; an empty
table gives an empty result; extra columns stay out of `pii_spans` and stay in with `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.text import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")

# Schemes whose addresses can carry a user, cues before identifiers.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:", "sip:", "xmpp:")
IBAN_CUES = ("IBAN", "iban", "Iban")
ACCOUNT_CUES = ("account no", "account number", "Account no", "Account number", "acct no", "Acct no", "Kontonummer", "Konto-Nr", "compte n", "Compte n", "cuenta n", "Cuenta n")

DIGITS = frozenset("0123456789")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = NAME | frozenset("._%+")

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_login = re.compile(r"[A-Za-z0-9._~%!$&'*+=-]+(?::[^\s@/:]*)?(?=@)").match
_iban = re.compile(r"[\s:#=.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])").match
_account = re.compile(r"[a-zA-Zº°.]{0,7}[\s:#=]{0,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z])").match


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("digit", DIGITS), ("scheme", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES)):
        for word in words:
            found.add_word(word, kind)
    found.make_automaton()
    return found


ANCHORS = _anchors()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), sorted."""
    spans = []
    past = [0] * len(KINDS)  # where the last candidate of each kind ended
    for last, anchor in ANCHORS.iter(text):
        if anchor == "digit":
            first = last == 0 or text[last - 1] not in DIGITS
            if last >= past[1] and (first or last == past[1]) and (m := _ip(text, last)):
                past[1] = m.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
                    spans.append((last, 1, m.end()))
            if last >= past[2] and (m := _card(text, last)):
                past[2] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((last, 2, m.end()))
        elif anchor == "@":
            start = last
            while start > past[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := _domain(text, last + 1)):
                past[0] = m.end()
                spans.append((start, 0, m.end()))
        elif anchor == "+":
            if last >= past[3] and (m := _phone(text, last)):
                past[3] = m.end()
                if 10 <= sum(c in DIGITS for c in m.group()) <= 15:
                    spans.append((last, 3, m.end()))
        elif anchor == "scheme":
            if last + 1 >= past[4] and (m := _login(text, last + 1)):
                past[4] = m.end()
                spans.append((m.start(), 4, m.end()))
        elif anchor == "iban":
            if last + 1 >= past[5] and (m := _iban(text, last + 1)) and iban_valid(m.group(1)):
                past[5] = m.end(1)
                spans.append((m.start(1), 5, m.end(1)))
        elif last + 1 >= past[6] and (m := _account(text, last + 1)):
            past[6] = m.end(1)
            spans.append((m.start(1), 6, m.end(1)))
    spans.sort()
    return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base kinds' spans), spans (all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [find(t or "") for t in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[1] < len(BASE)] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(BASE))),
                    pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                    pa.array([joined(s) for s in found], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    counts = "".join(f"n_{k} bigint, " for k in BASE)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}base_sha256 string, spans string")


def masked(text: str | None) -> str | None:
    """Every span replaced by its kind in angle brackets; of spans that overlap, one mark for all, named by the first."""
    if not text or not (spans := find(text)):
        return text
    out, end, group = [], 0, spans[0]
    for a, k, b in [*spans[1:], (len(text) + 1, 0, 0)]:
        if a < group[2]:
            group = group[0], group[1], max(b, group[2])
            continue
        out += [text[end : group[0]], f"<{KINDS[group[1]].upper()}>"]
        end, group = group[2], (a, k, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, personal data in the text masked; n_chars, where there is one, counts the new text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pa.array([masked(t) for t in batch.column("text").to_pylist()], batch.column("text").type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
