import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from joinseek.llm.quality import QualityParams, judged, log_ratios, ngram_counts, shape_words, text_counts

DRAW = random.Random(5)
VOCABULARY = ["".join(DRAW.choice("abcdefgh") for _ in range(DRAW.randint(2, 7))) for _ in range(60)]


def clean(n):
    return " ".join(DRAW.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


REPEATED = " ".join(VOCABULARY[:12])
TEXTS = [
    None,
    "",
    " \t\n\x0b ",
    "one",
    clean(8),
    clean(40),
    f"{REPEATED} x {REPEATED} y {REPEATED}",
    "a " * 50,
    f"{clean(30)}\n{REPEATED}\n\n{REPEATED}\n{clean(10)}\n  \n  \n",
    "w#x $y% &z | <a> *",
    "é ü ß x\x85y",
    " ".join(VOCABULARY[:8]) * 2,
    "z " * 20000 + clean(20000),
]


def counts(text):
    """All five counts as they are defined."""
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(found[i : i + 8]) for i in range(len(found) - 7))
    covered = set()
    for i in range(len(found) - 7):
        if windows[tuple(found[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    docs = docs.withColumn("n_words", F.lit("clash")).withColumn("h", F.lit(0))
    for r in text_counts(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counts(TEXTS[r.doc_id]), r.doc_id


def test_shapes(spark):
    row = spark.createDataFrame([("Hello WORLD!! ab12 ÉTÉ été | ***",)], "t string").select(shape_words(F.col("t"))).first()
    assert row[0] == ["Aa", "A!!", "a9", "A", "a", "|", "***"]


@pytest.fixture(scope="module")
def corpus(spark):
    good = [(i, clean(60)) for i in range(60)]
    junk = [(100 + i, " ".join(w.upper() + "!!" for w in clean(60).split())) for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id bigint")


def test_counts_cover_every_ngram(corpus):
    docs, trusted = corpus
    params = QualityParams(buckets=64)
    total = ngram_counts(docs, trusted, "text", "doc_id", params).agg(F.sum("target"), F.sum("raw")).first()
    assert tuple(total) == (30 * (2 * 60 - 1), 80 * (2 * 60 - 1))


def test_junk_is_told_from_clean_text(corpus):
    docs, trusted = corpus
    kept = {r.doc_id: r.kept for r in judged(docs, trusted).collect()}
    assert kept == {i: i < 100 for i in kept}
    # A filter on the verdict does not change it.
    assert judged(docs, trusted).where("NOT kept").count() == 20


def test_score_is_the_mean_log_ratio(spark, corpus):
    docs, trusted = corpus
    params = QualityParams(buckets=32)
    ratios = log_ratios(ngram_counts(docs, trusted, "text", "doc_id", params), params)
    row = judged(docs, trusted, params=params).where("doc_id = 101").first()
    shapes = spark.createDataFrame([(row.text,)], "t string").select(shape_words(F.col("t")).alias("s"))
    hashed = shapes.selectExpr("s", "posexplode(s) AS (i, w)").selectExpr(
        "pmod(xxhash64(w), 32) AS a", "IF(i + 1 < size(s), pmod(xxhash64(w, get(s, i + 1)), 32), NULL) AS b"
    )
    values = [ratios[x] for r in hashed.collect() for x in r if x is not None]
    assert abs(row.score - sum(values) / len(values)) < 1e-5


def test_odd_tables(spark, corpus):
    docs, trusted = corpus
    assert all(r.score == 0 for r in judged(docs, trusted.limit(0)).collect())
    assert judged(docs.limit(0), trusted).count() == 0
    odd = spark.createDataFrame([(None, clean(30)), (None, None), (1, ""), (1, clean(30)), (1, clean(30))], "doc_id bigint, text string")
    odd = odd.withColumn("kept", F.lit("clash"))
    assert sorted(r.kept for r in judged(odd, trusted).collect()) == [False, False, True, True, True]
