"""Repeated passages against a plain walk through the documents, and what stays."""

import random
import re

import pytest

from joinseek.llm import hot, repeated_lines
from joinseek.llm.repeated_lines import LineParams, without_repeats

SCHEMA = "doc_id bigint, text string"


def walked(rows, least):
    """{(doc_id, text): (text left, removed)}, from runs found by trying every end."""
    texts = sorted({(doc is None, doc or 0, repeated_number(text or ""), text or "") for doc, text in rows})
    seen, found = {}, {}
    for none, doc, _, text in texts:
        parts, at = [], 0
        for end in [*(m.end() for m in re.finditer(r"\n|[.!?](?=[ \t-\r])", text)), len(text)]:
            words = re.findall(r"[^ \t-\r]+", text[at:end])
            if words:
                parts.append((at, end, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]))
            at = end
        runs = set()
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                if sum(len(p[2]) for p in parts[a:b]) >= least:
                    runs.add((a, b))
                    break
            else:
                ends = [c for c in range(a, -1, -1) if sum(len(p[2]) for p in parts[c:]) >= least or c == 0]
                runs.add((ends[0], len(parts)))
        marks = []
        for a, b in sorted(runs):
            form = tuple(w for p in parts[a:b] for w in p[2])
            first = seen.setdefault(form, (none, doc, text, a))
            if first != (none, doc, text, a):
                marks.append((parts[a][0], parts[b - 1][1], None if first[0] else first[1]))
        spans = []
        for start, stop, doc_of in marks:
            if spans and start <= spans[-1][1]:
                kept = [d for d in (spans[-1][2], doc_of) if d is not None]
                spans[-1] = (spans[-1][0], max(stop, spans[-1][1]), min(kept) if kept else None)
            else:
                spans.append((start, stop, doc_of))
        left, at = "", 0
        for start, stop, _ in spans:
            left += text[at:start]
            at = stop
        found[None if none else doc, text] = (left + text[at:], spans)
    return found


def repeated_number(text):
    import hashlib

    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big", signed=True)


def check(spark, rows, least=6):
    docs = spark.createDataFrame([(*r, r[1]) for r in rows], SCHEMA + ", own string")
    got = [(r.doc_id, r.own, r.text, [tuple(x) for x in r.removed]) for r in without_repeats(docs, LineParams(least)).collect()]
    want = walked(rows, least)
    expected = [(d, t, None if t is None else want[d, t][0], want[d, t or ""][1]) for d, t in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@pytest.mark.parametrize("share", [2, 1000])
def test_random_documents(spark, monkeypatch, share):
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    monkeypatch.setattr(repeated_lines, "ROWS", 7)
    rnd = random.Random(share)
    pool = [" ".join(rnd.choice(["Ab", "é3", "3.14", "so", "ÜBER"]) for _ in range(rnd.randrange(1, 7))) for _ in range(14)]
    rows = [(k, "".join(rnd.choice(pool) + rnd.choice([". ", "\n", "!\n", " .  ", "\n\n"]) for _ in range(rnd.randrange(12)))) for k in range(90)]
    check(spark, rows)


def test_odd_rows(spark):
    passage = "A passage of words that is long enough to be one of those that are found. And one more."
    rows = [
        (1, f"{passage}\nx"), (1, f"{passage}\nx"), (1, f"y\n{passage}"), (None, passage), (None, "of no key, " + passage), (None, None), (2, f"{passage}\n{passage}"),
        (3, ""), (4, " \n\t\n"), (5, "short"), (6, "Short"), (7, "a word and " * 30_000), (8, "a word and " * 30_000 + "."), (9, "so. " * 1_500),
    ]
    check(spark, rows)


def test_chance_repeats_stay_and_blocks_go(spark):
    block = "Subscribe now\nles.\nAll rights of this page are reserved by the people who wrote it\nles.\nfirst of all the news from here, every single day"
    rows = [(1, "One.\nles.\nSubscribe now"), (2, f"Its own beginning\n{block}\nits own end"), (3, "Subscribe now\nsomething else\nles."), (4, f"another\n{block.upper()}\nend")]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "another\nend"}


def test_empty_table_and_clashing_columns(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    names = ["doc", "b1", "b2", "row", "own", "own_1", "whole", "cut", "digest", "a.b"]
    docs = spark.createDataFrame([(1, "the text", 5, *names), (2, "the text", 5, *names)], SCHEMA + ", removed int" + "".join(f", `{n}` string" for n in names))
    found = without_repeats(docs)
    assert found.columns == ["doc_id", "text", *names, "removed"]
    assert sorted(tuple(r)[:-1] for r in found.collect()) == [(1, "the text", *names), (2, "", *names)]
