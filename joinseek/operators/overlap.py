"""How well do two column lists join: overlap of their distinct values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.operators.keyrows import pair_counts
from joinseek.session import written

CANDIDATE = ["left_table", "right_table", "left", "right"]
INFO_TYPE = "array<struct<score:double,method:string>>"
EVAL_METHODS = ("SortedNeighborhood", "Merge")
SCORE_METHODS = ("jaccard", "cosine")

# The wording of the report's descriptions.
LENGTH_MISMATCH = "error - length mismatch"
WRONG_NAMES = "error - wrong column names"
EMPTY_INPUT = "empty input"
DONE = {"SortedNeighborhood": "Sorted Neighbourhood", "Merge": "Merge"}


def two_decimals(value: str) -> str:
    """A number from 0 up with two decimals, rounded on its exact binary value.

    ``format_string`` rounds the shortest decimal form half up instead. Here the
    fraction is a whole number of 2^-60, which holds all its bits wherever the
    second decimal is in doubt, and is rounded as such, half to even.
    """
    one = 1 << 60
    parts = f"named_struct('w', floor(v), 'h', CAST(CAST((v - floor(v)) * {one}D AS BIGINT) AS DECIMAL(20, 0)) * 100)"
    cents = f"x.h div {one}"
    rest = f"2 * (x.h % {one})"
    up = f"IF({rest} > {one} OR ({rest} = {one} AND ({cents}) % 2 = 1), 1, 0)"
    shown = "concat(c div 100, '.', lpad(c % 100, 2, '0'))"
    rounded = f"transform(array({parts}), x -> x.w * 100 + {cents} + {up})"
    return f"transform(array({value}), v -> transform({rounded}, c -> {shown})[0])[0]"


def _side_maps(catalog: DataFrame, side: str) -> DataFrame:
    """Per table a map from column name to its category and known key count."""
    known = "distinct + IF(missing > 0, 1, 0)"
    entry = f"struct(column, named_struct('category', category, 'known', {known}))"
    return catalog.groupBy(F.col("table").alias(f"{side}_table")).agg(
        F.expr(f"map_from_entries(collect_list({entry})) AS {side}_map")
    )


def upper_bound(n_left: str, n_right: str, score_method: str) -> str:
    """The best score two sets of these sizes can reach."""
    low, high = f"least({n_left}, {n_right})", f"greatest({n_left}, {n_right})"
    if score_method == "jaccard":
        return f"try_divide({low}, {high})"
    return f"try_divide({low}, sqrt(CAST({n_left} AS DOUBLE) * {n_right}))"


def _pruned(bound: str, min_join: float) -> str:
    return f"CASE WHEN {bound} < {min_join}D THEN concat('Pruned SN (', {two_decimals(bound)}, ')') END"


def check_candidates(candidates: DataFrame, catalog: DataFrame, score_method: str, min_join: float) -> DataFrame:
    """Candidates with a ``reason`` wherever no data needs to be read.

    Lists of unequal length, unknown columns and unequal categories fail here,
    and so do single pairs whose known distinct counts rule out ``min_join``.
    """
    joined = candidates
    for side in ("left", "right"):
        joined = joined.join(_side_maps(catalog, side), f"{side}_table", "left")
    info = "struct<category:string,known:bigint>"
    looked_up = joined.selectExpr(
        *candidates.columns,
        *(
            f"transform({side}, c -> CAST(try_element_at({side}_map, c) AS {info})) AS {short}"
            for side, short in (("left", "l"), ("right", "r"))
        ),
    )
    tested = looked_up.selectExpr(
        "*",
        "get(filter(arrays_zip(l, r), x -> x.l.category != x.r.category), 0) AS unequal",
        f"""CASE WHEN size(left) = 1 AND size(right) = 1
          THEN {upper_bound('l[0].known', 'r[0].known', score_method)} END AS bound""",
    )
    reason = f"""CASE WHEN size(left) != size(right) THEN '{LENGTH_MISMATCH}'
      WHEN exists(l, x -> x IS NULL) OR exists(r, x -> x IS NULL) THEN '{WRONG_NAMES}'
      WHEN unequal IS NOT NULL
        THEN concat('Category mismatch: ', unequal.l.category, '-', unequal.r.category)
      ELSE {_pruned('bound', min_join)} END AS reason"""
    return tested.selectExpr(*candidates.columns, reason)


def _known_keys(catalog: DataFrame, counted: DataFrame | None) -> DataFrame:
    """(table, columns, keys): key counts of single columns, missing values included, and those counted before."""
    single = catalog.selectExpr("table", "array(column) AS columns", "CAST(distinct + IF(missing > 0, 1, 0) AS BIGINT) AS keys")
    return single if counted is None else single.unionByName(counted)


def _counted(tables: Mapping[str, DataFrame], checked: DataFrame, known: DataFrame) -> DataFrame:
    """The checked candidates with key counts wherever the data must decide."""
    undecided = checked.where("reason IS NULL").select(*CANDIDATE).distinct()
    if undecided.isEmpty():
        unknown = (f"CAST(NULL AS BIGINT) AS {c}" for c in ("n_left", "n_right", "common", "full_common"))
        return checked.selectExpr("*", *unknown)
    return checked.join(pair_counts(tables, undecided, known), CANDIDATE, "left")


def measure_overlap(
    tables: Mapping[str, DataFrame],
    candidates: DataFrame,
    catalog: DataFrame,
    min_join: float = 0.45,
    eval_method: str = "SortedNeighborhood",
    score_method: str = "jaccard",
    key_counts: DataFrame | None = None,
) -> DataFrame:
    """Score every candidate: the report, one row per candidate.

    ``left_keys`` and ``right_keys`` are the distinct keys of each side, missing
    values included, where the data was read. Column sets whose keys are counted
    already may be named in ``key_counts`` (table, columns, keys); over large tables
    they are not counted again.
    Method ``SortedNeighborhood`` never matches missing values, since its exact
    comparison keeps equal values only; ``Merge`` matches them with each other.
    """
    if eval_method not in EVAL_METHODS:
        raise ValueError(f"eval_method must be one of {EVAL_METHODS}, not {eval_method!r}")
    if score_method not in SCORE_METHODS:
        raise ValueError(f"score_method must be one of {SCORE_METHODS}, not {score_method!r}")
    checked = written(check_candidates(candidates, catalog, score_method, min_join))
    known = _known_keys(catalog, key_counts)
    bounded = _counted(tables, checked, known).withColumn("bound", F.expr(upper_bound("n_left", "n_right", score_method)))
    matches = "common" if eval_method == "Merge" else "full_common"
    decided = bounded.selectExpr(
        *checked.columns[:-1],
        "n_left",
        "n_right",
        f"""CASE WHEN reason IS NOT NULL THEN reason WHEN n_left = 0 OR n_right = 0 THEN '{EMPTY_INPUT}'
          ELSE {_pruned('bound', min_join)} END AS reason""",
        f"{matches} AS found",
    ).selectExpr("*", "IF(reason IS NULL, found, 0L) AS matches")
    if score_method == "jaccard":
        total = "CAST(n_left + n_right - matches AS DOUBLE)"
    else:
        total = "sqrt(CAST(n_left AS DOUBLE) * n_right)"
    scored = decided.selectExpr("*", f"IF(reason IS NULL, {total}, 0.0D) AS total").selectExpr(
        "*", "coalesce(try_divide(CAST(matches AS DOUBLE), total), 0.0D) AS join_score"
    )
    return scored.selectExpr(
        "stage",
        *CANDIDATE,
        "similarity_info",
        "join_score",
        "matches",
        "total",
        "n_left AS left_keys",
        "n_right AS right_keys",
        f"(reason IS NULL AND join_score >= {min_join}D) AS mergeable",
        f"coalesce(reason, '{DONE[eval_method]}') AS description",
    )


def useful(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report split into mergeable and discarded candidates."""
    return report.where("mergeable"), report.where("NOT mergeable")


def rank(report: DataFrame) -> DataFrame:
    """Best score first; ties in column order."""
    return report.orderBy(F.desc("join_score"), *CANDIDATE)


# Fixed value: the wording of a line of the listing.
LINE = "Left: %s Right: %s Join score: %s (%s / %s) %s"


def listing(report: DataFrame) -> DataFrame:
    """One line of text per candidate: columns, score in percent, counts, reason."""
    line = f"""format_string('{LINE}', array_join(left, ', '), array_join(right, ', '),
      {two_decimals('join_score * 100')}, matches,
      IF(total = rint(total), CAST(CAST(total AS BIGINT) AS STRING), CAST(total AS STRING)), description) AS line"""
    return rank(report).selectExpr("stage", "left_table", "right_table", line)
