"""Unique keys, and the columns of another table that could refer to them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.operators.keyrows import duplicate_witnesses, key_counts
from joinseek.operators.overlap import INFO_TYPE
from joinseek.operators.profile import union_all
from joinseek.session import settle, text


MAX_SLICES = 64
SLACK = 1e-9


def unique_keys(
    tables: Mapping[str, DataFrame],
    catalog: DataFrame,
    min_ratio: float = 1,
    max_columns: int = 3,
    scope: Sequence[str] = ("table",),
) -> DataFrame:
    """Column sets whose distinct tuples make up ``min_ratio`` of the rows.

    Sizes 1, 2, 3 are tried in turn and a scope (by default a table) ends at its
    first size with a hit, with all hits of that size. The catalogue must hold
    distinct counts: they decide size 1 without a scan, and a set is scanned only
    if the product of its columns' distinct counts can reach the ratio. Duplicates
    in a slice of the values then refute most sets, and the rest is counted. Other
    columns may be listed in ``scope`` if the catalogue limits columns per scope.
    """
    group = [*scope] if "table" in scope else [*scope, "table"]
    single = catalog.where("rows > 0").selectExpr(
        *group,
        "rows",
        "struct(position, column AS name, category, distinct AS size) AS last",
        # A missing value counts as a value.
        "CAST(distinct + IF(missing > 0, 1, 0) AS DOUBLE) AS size",
    )
    level = single.selectExpr(*group, "rows", "array(last) AS members", "size AS bound")
    found = []
    for number in range(1, max_columns + 1):
        if number > 1:
            level = (
                level.join(single.drop("rows"), group)
                .where("last.position > element_at(members, -1).position")
                .selectExpr(*group, "rows", "concat(members, array(last)) AS members", "bound * size AS bound")
            )
        # Counted sets go on with their exact count, a closer bound for the next size.
        level = _with_key_counts(tables, level, min_ratio, group, number)
        names = "transform(members, m -> named_struct('name', m.name, 'category', m.category)) AS columns"
        hits = settle(
            level.selectExpr(*group, f"{number} AS number", names, "keys / rows AS percentage").where(
                f"percentage >= {min_ratio}D"
            )
        )
        found.append(hits)
        level = level.join(hits.select(*group).distinct(), group, "left_anti")
        if number < max_columns and level.isEmpty():
            break
    return union_all(found)


def slices_for(min_ratio: float) -> int:
    """Into how many slices values are dealt, one of which is searched for duplicates.

    A slice must be able to hold more duplicates than the ratio allows in all: the
    more it allows, the larger the slice.
    """
    return max(2, min(MAX_SLICES, round(0.5 / max(1 - min_ratio, SLACK))))


def _with_key_counts(
    tables: Mapping[str, DataFrame], level: DataFrame, min_ratio: float, group: list[str], number: int
) -> DataFrame:
    """The sets of one size with ``keys`` where their bound can reach the ratio."""
    if number == 1:
        return level.withColumn("keys", F.col("bound"))
    level = level.selectExpr("*", "members.name AS names")
    # Of each set the column with the most values, which slices it most evenly.
    slicer = "array_max(transform(members, m -> struct(m.size AS size, m.name AS name))).name AS slicer"
    possible = level.where(f"bound >= rows * {min_ratio}D").selectExpr("table", "names", slicer).distinct()
    sets = {(r.table, tuple(r.names)): r.slicer for r in possible.collect()}
    if not sets:
        return level.selectExpr("*", "CAST(NULL AS DOUBLE) AS keys").drop("names")
    seen = duplicate_witnesses(level.sparkSession, tables, sets, slices_for(min_ratio)).withColumnRenamed("columns", "names")
    level = level.join(settle(seen), ["table", "names"], "left")
    # What the witnesses leave of a set's rows is a bound as well, and refutes it if it is too low.
    fields = [f for f in level.columns if f not in ("bound", "duplicates")]
    level = level.selectExpr(*fields, "least(bound, rows - coalesce(duplicates, 0L)) AS bound")
    left = level.where(f"bound >= rows * {min_ratio}D").select("table", "names").distinct()
    sets = sorted({(r.table, tuple(r.names)) for r in left.collect()})
    if not sets:
        return level.selectExpr("*", "CAST(NULL AS DOUBLE) AS keys").drop("names")
    counts = settle(key_counts(level.sparkSession, tables, sets).withColumnRenamed("columns", "names"))
    counted = level.join(counts, ["table", "names"], "left")
    return counted.selectExpr(*group, "rows", "members", "CAST(coalesce(keys, bound) AS DOUBLE) AS bound", "keys")


def foreign_keys(
    keys: DataFrame,
    catalog: DataFrame,
    on: Sequence[tuple[str, str]],
    key_side: str = "left",
    stage: str = "S3",
    max_columns: int = 3,
) -> DataFrame:
    """Candidates that assign to each key column another column of its category.

    ``keys`` are unique keys with the table pair on each row, ``catalog`` the
    columns of the other table; ``on`` names the fields both agree on. No column
    serves twice in a candidate.
    """
    fields = [k for k, _ in on]
    other = catalog.selectExpr(*(f"{c} AS {k}" for k, c in on), "column AS option", "category")
    grown = keys.selectExpr(*fields, "columns", "CAST(array() AS ARRAY<STRING>) AS chosen")
    done = []
    for i in range(max_columns):
        wanted = grown.where(f"size(columns) > {i}").selectExpr("*", f"columns[{i}].category AS category")
        grown = (
            wanted.join(other, [*fields, "category"])
            .where("NOT array_contains(chosen, option)")
            .selectExpr(*fields, "columns", "concat(chosen, array(option)) AS chosen")
        )
        done.append(grown.where(f"size(columns) = {i + 1}"))
    left, right = ("columns.name", "chosen") if key_side == "left" else ("chosen", "columns.name")
    return union_all(done).selectExpr(
        f"{text(stage)} AS stage",
        *fields,
        f"{left} AS left",
        f"{right} AS right",
        f"CAST(array() AS {INFO_TYPE}) AS similarity_info",
    )
