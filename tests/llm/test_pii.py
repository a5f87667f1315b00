import re

import pytest
from pyspark.sql import functions as F

from joinseek.llm.pii import find_spans, redact, span_list


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def base(text):
    """The four plain kinds as they are defined."""
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", luhn),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    }
    return ",".join(
        f"{kind}:{m.start()}:{m.end()}" for kind, (p, good) in kinds.items() for m in re.finditer(p, text) if good(m.group())
    )


TEXTS = [
    None,
    "",
    "no data here",
    "a@b.c_d@e.fg and a@b.c.@d.e x@y",
    "ä€😀 me.too+x@mail-1.example.com, 😀 +1 (555) 123-4567.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.00000000000000000000.9 1.2.3 10.0.0.1.",
    "4111 1111 1111 1111 4111111111111112 4465758382889437 4465758382889437",
    "+1 (663) 555-6869 4465758382889437 +12345678 +1234567890123456 +1-2+3 5555555555",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32",
    'api_key = "abcdef0123456789" password=hunter2hunter',
    "ssn 123-45-6789, order 987-65-4321, part 123-45-6789",
    "5" * 30000 + " a@" + "b" * 30000 + "a." * 20000 + "+" + "1(" * 20000,
    "x@y.z " * 3000,
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = find_spans(docs).select("doc_id", "spans", span_list("spans", True).alias("b"), span_list("spans").alias("s"))
    return {r.doc_id: r for r in out.collect()}


def test_base_spans_equal_the_plain_patterns(found):
    for i, text in enumerate(TEXTS):
        assert found[i].b == base(text or ""), text and text[:60]


def texts(found, i, kind):
    return [TEXTS[i][x.start : x.stop] for x in found[i].spans if x.kind == kind]


def test_method_adds_checked_spans(found):
    assert texts(found, 6, "card")[-2:] == ["4465758382889437"] * 2
    assert "+1 (663) 555-6869" in texts(found, 7, "phone") and "4465758382889437" in texts(found, 7, "card")
    assert texts(found, 8, "iban") == ["GB82 WEST 1234 5698 7654 32"]
    assert len(texts(found, 9, "secret")) == 2
    # The pattern alone scores too little; context decides.
    assert texts(found, 10, "ssn") == ["123-45-6789"] and found[10].spans[0].start == 4


def test_listing_is_by_kind_then_place(found):
    order = ["email", "ip", "card", "phone", "iban", "secret", "ssn"]
    for row in found.values():
        places = [(order.index(x.kind), x.start) for x in row.spans]
        assert places == sorted(places)


def test_redaction(spark):
    rows = [(1, "mail a@b.cd now", 5), (2, None, None), (3, "", 0), (1, "mail a@b.cd now", 5), (None, "clean", 1), (5, "call +1 (663) 555-6869 4465758382889437", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int").withColumn("kind", F.lit("k"))
    out = redact(docs)
    assert out.columns == docs.columns
    got = [r.text for r in out.collect()]
    assert got == ["mail <EMAIL> now", None, "", "mail <EMAIL> now", "clean", "call <PHONE> <CARD>"]
    assert redact(docs.limit(0)).count() == 0
    assert out.where("text LIKE '%<EMAIL>%'").count() == 2


def test_many_spans_in_one_text(spark):
    # More spans than a block and a text longer than its pieces, with spans across both borders.
    parts = [f"é{'x' * (i % 90)} {i}@b.de 12-34 +49 30 12345{i:04d}" for i in range(700)]
    text = "\n".join(parts)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in find_spans(docs).collect()}
    emails = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+@b\.de", text)]
    assert [(s.start, s.stop) for s in found[1] if s.kind == "email"] == emails
    assert found[2] == found[3] == []
    redacted = {r.doc_id: r.text for r in redact(docs).collect()}
    assert redacted[1] == re.sub(r"\+49 30 [0-9]+", "<PHONE>", re.sub(r"[0-9]+@b\.de", "<EMAIL>", text))
    assert (redacted[2], redacted[3]) == (None, "")
