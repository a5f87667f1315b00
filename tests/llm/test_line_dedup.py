"""Lines that several documents hold, against a plain count."""

import random
from collections import defaultdict

import pytest

from joinseek.llm import hot
from joinseek.llm.line_dedup import BLANK, UPPER, LineDedupParams, without_repeated_lines

LOWER = str.maketrans(UPPER, UPPER.lower())
SCHEMA = "doc_id bigint, text string"


def plain(rows, least=10, documents=2):
    """{(doc_id, text): (lines, dropped, text left)}; no key ranks last."""
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held[line.strip(BLANK).translate(LOWER)].add((doc is None, doc))
    left = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        keys = [line.strip(BLANK).translate(LOWER) for line in lines]
        stays = [
            line
            for line, key in zip(lines, keys, strict=True)
            if len(key) < least or len(held[key]) < documents or min(held[key]) == (doc is None, doc)
        ]
        left[doc, text] = (len(lines), len(lines) - len(stays), "\n".join(stays))
    return left


def check(spark, rows, **params):
    found = without_repeated_lines(spark.createDataFrame(rows, SCHEMA).withColumn("own", spark_text()), LineDedupParams(**params))
    got = [(r.doc_id, r.own, (r.n_lines, r.n_dropped, r.text)) for r in found.collect()]
    want = plain(rows, **{k.replace("min_chars", "least").replace("min_documents", "documents"): v for k, v in params.items()})
    assert sorted(map(repr, got)) == sorted(repr((d, t, want[d, t])) for d, t in rows)


def spark_text():
    from pyspark.sql import functions as F

    return F.col("text")


def test_keys_and_places(spark):
    rows = [
        (1, "First line here\nSECOND line here \r\n\nfirst LINE here"),
        (2, "\tfirst line here\x0b\nother line of two\nsecond line here"),
        (3, "other line of two\nother line of two\nshort\nÉcole normale x"),
        (4, "short\nécole normale x\nfirst line herė\n"),
        (5, "a line with \xa0\n123456789\n"),
        (6, "123456789\n1234567890\na line with "),
        (7, "1234567890"),
        (8, None),
        (9, ""),
        (10, "\n"),
        (11, "first line here x\nfirst line here"),
    ]
    check(spark, rows)


def test_odd_rows(spark):
    long = "\n".join(f"line number {k % 7000}" for k in range(40000))
    rows = [
        (None, "a repeated line"), (None, "a repeated line"), (None, "of no document\na repeated line"), (None, None),
        (5, "a repeated line\nits own line, at 5"), (5, "a repeated line\nits own line, at 5"), (5, "a second text of 5\na repeated line"),
        (7, "of no document"), (3, long), (4, long + "\nits own line, at 5"),
    ]
    check(spark, rows)
    check(spark, rows, min_chars=3, min_documents=3)


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_hot_lines_and_random_texts(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    rnd = random.Random(share)
    lines = [f"A line of text {k}" for k in range(12)] + ["", "short", " the COMMON line "]
    rows = [(k, "\n".join(rnd.choices(lines, k=rnd.randrange(6)) + ["The common line"] * (k % 2))) for k in range(120)]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert without_repeated_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    names = ["n_lines", "n_dropped", "doc", "body", "places", "row", "whole", "own", "lines", "digest", "a.b"]
    schema = SCHEMA + "".join(f", `{n}` string" for n in names)
    docs = spark.createDataFrame([(1, "twice the same line", *names), (2, "twice the same line", *names)], schema)
    found = without_repeated_lines(docs)
    assert found.columns == ["doc_id", "text", *names[2:], "n_lines", "n_dropped"]
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(1, "twice the same line", *names[2:], 1, 0), (2, "", *names[2:], 1, 1)]
