"""String similarity between 0 and 1, as SQL text over two SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equality(a: str, b: str) -> str:
    return f"CAST({a} = {b} AS DOUBLE)"


def levenshtein(a: str, b: str) -> str:
    """1 - edit distance over the longer length; two empty strings are equal."""
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}), 1))"


def jaro(a: str, b: str) -> str:
    """Plain Jaro similarity.

    One fold over the characters of ``a`` takes the first unused equal character
    of ``b`` within the match window and marks it used; the marks then give the
    matched characters of ``b`` in order, and so the transpositions.
    """
    reach = f"greatest(CAST(floor(greatest(length({a}), length({b})) / 2) AS INT) - 1, 0)"
    char = f"substring({a}, jaro_i, 1)"
    low = f"greatest(jaro_i - {reach}, 1)"
    near = f"substring(jaro_s.rest, {low}, jaro_i + {reach} - {low} + 1)"
    step = (
        f"CASE WHEN contains({near}, {char}) THEN named_struct("
        f"'rest', overlay(jaro_s.rest, chr(0), locate({char}, jaro_s.rest, {low}), 1), "
        f"'taken', concat(jaro_s.taken, {char})) ELSE jaro_s END"
    )
    marked = f"filter(sequence(1, length({b})), jaro_j -> substring(jaro_s.rest, jaro_j, 1) = chr(0))"
    swapped = (
        "filter(sequence(1, length(jaro_s.taken)), jaro_k -> "
        f"substring(jaro_s.taken, jaro_k, 1) != substring({b}, get({marked}, jaro_k - 1), 1))"
    )
    m = "length(jaro_s.taken)"
    finish = (
        f"CASE WHEN {m} = 0 THEN 0.0D ELSE ({m} / length({a}) + {m} / length({b}) "
        f"+ ({m} - floor(size({swapped}) / 2)) / {m}) / 3 END"
    )
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0D "
        f"ELSE aggregate(sequence(1, length({a})), named_struct('rest', {b}, 'taken', ''), "
        f"(jaro_s, jaro_i) -> {step}, jaro_s -> {finish}) END"
    )


# Semantic similarity needs a taxonomy table, so it is a join, not an
# expression: see operators/semantic.py.
METHODS = {"Equality": equality, "Levenshtein": levenshtein, "Jaro": jaro}


def similarity_struct(a: str, b: str, method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown similarity method {method!r}; choose from {sorted(METHODS)}")
    return f"named_struct('score', {METHODS[method](a, b)}, 'method', '{method}')"


def string_similarity(a: str, b: str, method: str = "Equality") -> Column:
    """``struct<score, method>`` for two string columns, case-sensitive."""
    return F.expr(similarity_struct(a, b, method))
