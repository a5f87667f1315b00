"""Candidates from column names: equal names, or similar ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from joinseek.functions.strings import METHODS, similarity_struct
from joinseek.operators.overlap import INFO_TYPE
from joinseek.operators.semantic import Taxonomy, semantic_similarity
from joinseek.session import text


# The least ratio of lengths with which a name pair can reach a score: an edit
# distance is no less than the difference in length, and Jaro at most a mean of
# the ratio and two ones.
LENGTH_BOUND = {"Levenshtein": lambda score: score, "Jaro": lambda score: 3 * score - 2}
SLACK = 1e-9


def column_pairs(catalog: DataFrame, pairs: DataFrame, on: str | None = None) -> DataFrame:
    """Columns of the left table beside those of the right one, per table pair.

    ``on`` asks for equality of one catalogue field, as part of the join.
    """
    fields = ["table", "column", "category"]
    left = catalog.selectExpr(*(f"{c} AS left_{c}" for c in fields))
    right = catalog.selectExpr(*(f"{c} AS right_{c}" for c in fields))
    sided = pairs.join(left, "left_table")
    condition = sided["right_table"] == right["right_table"]
    if on is not None:
        condition &= sided[f"left_{on}"] == right[f"right_{on}"]
    return sided.join(right, condition).drop(right["right_table"])


def _as_candidates(found: DataFrame, stage: str) -> DataFrame:
    return found.selectExpr(
        f"{text(stage)} AS stage",
        "left_table",
        "right_table",
        "array(left_column) AS left",
        "array(right_column) AS right",
        f"CAST(similarity_info AS {INFO_TYPE}) AS similarity_info",
    )


def common_columns(catalog: DataFrame, pairs: DataFrame, stage: str = "S1") -> DataFrame:
    """Column pairs with the same name."""
    found = column_pairs(catalog, pairs, on="column")
    equal = "array(named_struct('score', 1.0D, 'method', 'Equality')) AS similarity_info"
    return _as_candidates(found.selectExpr("*", equal), stage)


def similar_columns(
    catalog: DataFrame,
    pairs: DataFrame,
    methods: Sequence[tuple[str, float]],
    taxonomy: Taxonomy | None = None,
    stage: str = "S2",
) -> DataFrame:
    """Column pairs whose names reach the minimum of any method.

    ``similarity_info`` lists the methods that did. The method ``Semantic``
    needs a taxonomy and is left out without one.
    """
    known = {*METHODS, "Semantic"}
    for method, _ in methods:
        if method not in known:
            raise ValueError(f"unknown similarity method {method!r}; choose from {sorted(known)}")
    shortest, longest = (f"{f}(length(left_column), length(right_column))" for f in ("least", "greatest"))
    beside = column_pairs(catalog, pairs)
    # Each pair of names is scored once, in however many table pairs it occurs.
    named = beside.select("left_column", "right_column").distinct()
    bounds = []
    scores = []
    for method, minimum in methods:
        if method == "Semantic":
            if taxonomy is None:
                continue
            scored = semantic_similarity(named, taxonomy, "left_column", "right_column", "semantic")
            named = named.join(scored, ["left_column", "right_column"])
            info = "named_struct('score', semantic, 'method', 'Semantic')"
            bounds.append("true")
        else:
            info = similarity_struct("left_column", "right_column", method)
            bound = "true"
            if method in LENGTH_BOUND:
                bound = f"{shortest} >= {LENGTH_BOUND[method](minimum) - SLACK}D * {longest}"
                info = f"IF({bound}, {info}, NULL)"
            bounds.append(bound)
        scores.append(f"named_struct('info', {info}, 'least', {minimum}D)")
    if not scores:
        return common_columns(catalog, pairs, stage).limit(0)
    near = named.where(" OR ".join(f"({b})" for b in bounds))
    scored = near.selectExpr("left_column", "right_column", f"array({', '.join(scores)}) AS scores")
    reached = scored.selectExpr("*", "filter(scores, s -> s.info.score >= s.least).info AS similarity_info").drop("scores")
    found = beside.join(reached, ["left_column", "right_column"]).where("size(similarity_info) > 0")
    return _as_candidates(found, stage)


def same_category_pairs(catalog: DataFrame, pairs: DataFrame, stage: str = "S4") -> DataFrame:
    """Every column pair of equal category."""
    found = column_pairs(catalog, pairs, on="category")
    return _as_candidates(found.selectExpr("*", "array() AS similarity_info"), stage)
