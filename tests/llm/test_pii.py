"""Personal data against the patterns as stated, in Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gavelstat.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [
        (m.start(), n, k, m.end())
        for n, (k, p) in enumerate(PATTERNS.items())
        for m in re.finditer(p, text or "")
        if valid(k, m[0])
    ]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


def texts():
    rng = random.Random(4)
    parts = [
        "a@b.co", "x.y+z%_-@d-e.f.g", "@", ".", "..", "a@b", "a@b.c_d@e.f", "_d@e.f", "1.2.3.4", "001.002.003.0255", "256.1.1.1",
        "1.2.3.4.5.6.7.8", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111", "41111111111111111", "378282246310005", "0",
        "6011000990139424", "+1 (829) 555-7292", "+44 20 7946 0958", "+1", "+12", "+1-2", "++1 234 567 8901", "+1.800.555.0199.",
        " ", "  ", "\n", "-", "é", "漢", "🙂", "word", "12 34", "99999999999999999999999", "00000000000000", "(", ")", ":", ",",
    ]
    yield from (None, "", "a@b.co", "+1 (829) 555-7292", "🙂 é a@b.co 1.2.3.4")
    for _ in range(1200):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
    yield "card 4111 1111 1111 1111 " * 700
    yield "a" * 60_000 + "@b.c " + "1" * 60_000 + " " + "+1" * 20_000 + "a.b" * 20_000


@pytest.fixture(scope="module")
def found(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS spans", "'x' AS _found", "2 AS email")
    return dict(rows), {r.doc_id: r for r in pii.summary(pii.find(docs)).collect()}


def test_base_spans_equal_the_patterns(found):
    rows, got = found
    for doc_id, text in rows.items():
        spans = brute(text)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (text, spans, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in spans) for k in PATTERNS]
        kept = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert kept == spans


def test_checksums_and_context_add_spans(spark):
    rows = [
        (1, "pay to IBAN DE89 3704 0044 0532 0130 00 today"), (2, "GB82WEST12345698765432"), (3, "GB82WEST12345698765433"),
        (4, "my SSN is 123-45-6789"), (5, "part 123-45-6789 of it"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in pii.summary(pii.find(docs)).collect()}
    assert got == {1: "iban:12:39", 2: "iban:0:22", 3: "", 4: "tax_id:10:21", 5: ""}
    scores = {r.doc_id: [s.score for s in r.spans] for r in pii.find(docs).collect()}
    assert scores[1] == [1.0] and scores[2] == [0.7]


def test_running_totals_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    text = "1.2.3.4 x " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [r.spans for r in pii.summary(pii.find(docs)).collect()] == [",".join(brute(text))]
    assert pii.find(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string").withColumn("text", F.concat("text", F.lit("")))
    plan = pii.summary(pii.find(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
