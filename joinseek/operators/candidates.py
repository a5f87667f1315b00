"""Multi-column candidates, and candidates ruled out by earlier results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.operators.overlap import INFO_TYPE
from joinseek.operators.profile import union_all
from joinseek.session import text

PAIR = ["left_table", "right_table"]
SINGLE = "named_struct('left', left[0], 'right', right[0])"


def column_combinations(candidates: DataFrame, sizes: Sequence[int] = (2, 3), stage: str | None = None) -> DataFrame:
    """All combinations of the single pairs of each table pair.

    Every left and every right column occurs once per combination, and pairs
    stay in name order, so each combination appears once.
    """
    label = f"{text(stage)} AS stage" if stage is not None else "stage"
    singles = candidates.where("size(left) = 1").selectExpr(*PAIR, label, f"{SINGLE} AS last").distinct()
    grown = singles.selectExpr(*PAIR, "stage", "array(last) AS members")
    found = []
    for size in range(2, max(sizes) + 1):
        grown = (
            grown.join(singles.select(*PAIR, "last"), PAIR)
            .where("last > element_at(members, -1)")
            .where("NOT array_contains(members.left, last.left) AND NOT array_contains(members.right, last.right)")
            .selectExpr(*PAIR, "stage", "concat(members, array(last)) AS members")
        )
        if size in sizes:
            found.append(grown)
    return union_all(found).selectExpr(
        "stage",
        *PAIR,
        "members.left AS left",
        "members.right AS right",
        f"CAST(array() AS {INFO_TYPE}) AS similarity_info",
    )


def without_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates not yet in ``known``, whatever the order of their column pairs.

    Pairs are sorted as pairs: (x, y) to (u, v) and (x, y) to (v, u) are two
    candidates, of which the reference program would score the first only.
    """
    order = "array_sort(arrays_zip(left, right)) AS sorted_pairs"
    old = known.selectExpr(*PAIR, order).distinct()
    keyed = candidates.selectExpr("*", order)
    return keyed.join(old, [*PAIR, "sorted_pairs"], "left_anti").select(candidates.columns)


def hier_parents(report: DataFrame, max_matches: int = 1) -> DataFrame:
    """Per table pair the single pairs that failed with at most ``max_matches``."""
    failed = report.where(f"NOT mergeable AND matches <= {max_matches} AND size(left) = 1")
    return failed.groupBy(*PAIR).agg(F.expr(f"collect_set({SINGLE}) AS parents"))


def split_by_parents(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Multi-column candidates with ``is_child`` and the pairs that remain.

    A child contains a failed single pair; ``remaining`` are its other pairs.
    """
    members = "transform(arrays_zip(left, right), p -> named_struct('left', p.left, 'right', p.right))"
    joined = candidates.join(parents, PAIR, "left").selectExpr("*", f"{members} AS members")
    rest = joined.selectExpr("*", "IF(parents IS NULL, members, array_except(members, parents)) AS remaining")
    child = "(size(remaining) < size(members) AND size(left) > 1) AS is_child"
    return rest.selectExpr(*candidates.columns, child, "remaining")


def hier_discard(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Candidates that contain no failed single pair."""
    return split_by_parents(candidates, parents).where("NOT is_child").select(candidates.columns)


def hier_singles(singles: DataFrame, parents: DataFrame) -> DataFrame:
    """Single pairs that may enter combinations: all but the failed ones.

    Leaving a failed pair out beforehand gives the same combinations as
    ``hier_discard`` on all of them, without building the others.
    """
    failed = parents.selectExpr(*PAIR, "explode(parents) AS failed")
    keyed = singles.selectExpr("*", f"{SINGLE} AS failed")
    return keyed.join(failed, [*PAIR, "failed"], "left_anti").drop("failed")
