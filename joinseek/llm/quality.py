"""Quality rules: a log-likelihood ratio of hashed n-grams, and plain text counts.

The n-grams are made of word shapes (letters in runs of ``A`` and ``a``, digits
as ``9``, the rest as it is), since the vocabulary of a corpus has no end but
its shapes do. Two multinomials over hash buckets are counted, one over the
trusted documents and one over all documents; the score of a document is the
mean over its n-grams of the logarithm of their ratio.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.text import computed_once, kept_table, words
from joinseek.session import quoted

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityParams:
    """``buckets`` bounds the two multinomials; only they are gathered."""

    buckets: int = 4096
    smoothing: float = 1.0
    min_score: float = -0.25
    min_words: int = 20
    max_repeat_percent: int = 30


def shape_words(text: Column) -> Column:
    """The words of a text with their letters and digits reduced to classes."""
    # The plain ranges are part of the classes, but quicker to test.
    shape = F.regexp_replace(F.coalesce(text, F.lit("")), r"[a-z\p{Ll}]+", "a")
    shape = F.regexp_replace(shape, r"[A-Z\p{Lu}]+", "A")
    return words(F.regexp_replace(shape, r"[0-9]+", "9"))


def _bucket(parts: str, buckets: int) -> str:
    return f"CAST(pmod(xxhash64({parts}), {buckets}) AS INT)"


def ngram_counts(docs: DataFrame, trusted: DataFrame, text: str, key: str, params: QualityParams) -> DataFrame:
    """Counts per bucket, (bucket, target, raw), over every n-gram of all documents.

    Rows of ``docs`` whose key is in ``trusted`` count for both sides. Only keys
    and shapes are shuffled to tell them, and rows are counted before the shuffle
    by bucket.
    """
    marked = trusted.select(F.col(key).alias("__key")).distinct().withColumn("__trusted", F.lit(1))
    shapes = docs.select(F.col(quoted(key)).alias("__key"), F.array_join(shape_words(F.col(quoted(text))), " ").alias("__s"))
    # Else the shapes would be made a second time, by the test for empty texts.
    shapes = computed_once(shapes, "__s").join(marked, "__key", "left").selectExpr("__trusted", "split(__s, ' ') AS __w", "__s = '' AS __empty")
    grams = shapes.where("NOT __empty").selectExpr("__trusted", "__w", "posexplode(__w) AS (__i, __a)")
    both = grams.selectExpr(
        "__trusted",
        f"{_bucket('__a', params.buckets)} AS one",
        f"IF(__i + 1 < size(__w), {_bucket('__a, get(__w, __i + 1)', params.buckets)}, NULL) AS two",
    )
    # Two counts of shapes, not one of twice the rows.
    pairs = both.groupBy("one", "two").agg(F.count("__trusted").alias("target"), F.count(F.lit(1)).alias("raw"))
    each = pairs.selectExpr("explode(array(one, two)) AS bucket", "target", "raw").where("bucket IS NOT NULL")
    return each.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, params: QualityParams) -> list[float]:
    """The log ratio of each bucket; zeros if nothing is trusted.

    At most ``params.buckets`` rows come to the driver, whatever the corpus.
    """
    totals = counts.agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).first()
    if not totals.target:
        return [0.0] * params.buckets
    smooth, spread = params.smoothing, params.smoothing * params.buckets
    shares = [f"ln((coalesce({side}, 0) + {smooth}D) / {totals[side] + spread}D)" for side in ("target", "raw")]
    every = counts.sparkSession.range(params.buckets).join(counts, F.col("id") == F.col("bucket"), "left")
    rows = every.selectExpr("id", f"round({shares[0]} - {shares[1]}, 9) AS ratio").collect()
    ratios = {row.id: row.ratio for row in rows}
    return [ratios[bucket] for bucket in range(params.buckets)]


def score(docs: DataFrame, ratios: list[float], text: str, into: str, buckets: int) -> DataFrame:
    """``docs`` with the mean log ratio of the n-grams of ``text``; 0 without any."""
    table = f"array({', '.join(f'{r}D' for r in ratios)})"
    rest = [quoted(c) for c in docs.columns if c != into]
    one = f"get({table}, {_bucket('get(__shapes, i)', buckets)})"
    two = f"IF(i + 1 < size(__shapes), get({table}, {_bucket('get(__shapes, i), get(__shapes, i + 1)', buckets)}), 0D)"
    total = f"aggregate(sequence(0, size(__shapes) - 1), 0D, (sum, i) -> sum + {one} + {two})"
    mean = f"IF(size(__shapes) = 0, 0D, round({total} / (2 * size(__shapes) - 1), 6)) AS {quoted(into)}"
    scored = docs.select(*rest, shape_words(F.col(quoted(text))).alias("__shapes")).selectExpr(*rest, mean)
    return computed_once(scored, into)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words in repeated windows are counted once each: windows are hashed, and only
    a text in which two hashes agree is sorted to find the places. All counts of
    a null text are 0; columns that have one of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rest = [quoted(c) for c in docs.columns if c not in made]
    source = F.coalesce(F.col(quoted(text)), F.lit(""))
    split = docs.select(
        *rest,
        words(source).alias("__words"),
        (F.size(F.split(source, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        F.filter(F.split(source, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    counted = split.selectExpr(
        *rest,
        "CAST(size(__words) AS BIGINT) AS n_words",
        "CAST(length(array_join(__words, '')) AS BIGINT) AS word_chars",
        "n_symbols",
        "CAST(size(__lines) - size(array_distinct(__lines)) AS BIGINT) AS n_dup_lines",
        "transform(__words, w -> xxhash64(w)) AS __hashes",
    )
    places = ", ".join(f"get(__hashes, i + {k})" for k in range(WINDOW))
    windows = f"transform(sequence(0, size(__hashes) - {WINDOW}), i -> xxhash64({places}))"
    none = "CAST(array() AS array<bigint>)"
    counts = made[:4]
    windowed = counted.selectExpr(*rest, *counts, f"IF(size(__hashes) > {WINDOW}, {windows}, {none}) AS __windows")
    sorted_places = "sort_array(transform(__windows, (h, i) -> named_struct('h', h, 'i', i)))"
    nothing = "CAST(array() AS array<struct<h:bigint,i:int>>)"
    ordered = windowed.selectExpr(
        *rest, *counts, f"IF(size(array_distinct(__windows)) < size(__windows), {sorted_places}, {nothing}) AS __order"
    )
    twin = "filter(__order, (x, k) -> get(__order, k + 1).h = x.h OR (k > 0 AND get(__order, k - 1).h = x.h))"
    repeated = ordered.selectExpr(*rest, *counts, f"sort_array(transform({twin}, x -> x.i)) AS __starts")
    covered = f"""aggregate(sequence(0, size(__starts) - 1), 0,
        (sum, k) -> sum + least({WINDOW}, coalesce(get(__starts, k + 1) - get(__starts, k), {WINDOW})))"""
    repeat_words = f"CAST(IF(size(__starts) = 0, 0, {covered}) AS BIGINT) AS n_repeat_words"
    return computed_once(repeated.selectExpr(*rest, *counts, repeat_words), *made)


def judged(docs: DataFrame, trusted: DataFrame, text: str = "text", key: str = "doc_id", params: QualityParams | None = None) -> DataFrame:
    """``docs`` with the text counts, the score, ``base_failed`` and ``kept``.

    ``trusted`` has one column of keys of trusted documents. A document is kept
    if it passes the plain rules and its score is at least ``params.min_score``;
    the threshold is the same number for every document. With nothing trusted, or
    an empty table, the score is 0 and only the plain rules decide.
    """
    params = params or QualityParams()
    counts = kept_table(ngram_counts(docs, trusted, text, key, params), "ngrams")
    scored = score(docs, log_ratios(counts, params), text, "score", params.buckets)
    failed = f"n_words < {params.min_words} OR 100 * n_repeat_words > {params.max_repeat_percent} * n_words"
    counted = text_counts(scored, text).withColumn("base_failed", F.expr(failed))
    return counted.withColumn("kept", F.expr(f"NOT base_failed AND score >= {params.min_score}D"))
