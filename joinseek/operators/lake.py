"""Every pair of joinable columns of a lake, without counting every pair of columns.

Columns are sets of values. Two sets that overlap enough must share one of the
first few values of each, if all values are ordered alike; with the values first
that few columns hold, most columns have nothing there that another one has. The
pairs that meet in these prefixes are the candidates, and only they are counted.
"""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.functions.values import PARTS, is_missing, key_parts, needs_text
from joinseek.operators.profile import union_all
from joinseek.session import local_table, written

SLACK = 1e-9


def _values(tables: Mapping[str, DataFrame], catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(category, l, d, s, own, number) of every value of every column, and the columns by number.

    Whether a column is a number, a date or a text is in the catalogue; values of
    different categories do not meet. A missing value equals no other, so it
    carries the number of its column as ``own``.
    """
    names = sorted((t, c) for t, df in tables.items() for c in df.columns)
    numbers = local_table(
        catalog.sparkSession,
        {"number": list(range(len(names))), "table": [t for t, _ in names], "column": [c for _, c in names]},
        {"number": pa.int32(), "table": pa.string(), "column": pa.string()},
    )
    as_text = any(needs_text(f.dataType) for df in tables.values() for f in df.schema)
    place = {name: k for k, name in enumerate(names)}
    frames = []
    for table, df in tables.items():
        rows = []
        for field in df.schema:
            number = place[table, field.name]
            held = key_parts(field.name, field.dataType, as_text)
            parts = ", ".join(f"'{p}', {held.get(p, f'CAST(NULL AS {kind})')}" for p, kind in PARTS.items())
            own = f"IF({is_missing(field.name, field.dataType)}, {number}, NULL)"
            rows.append(f"named_struct({parts}, 'own', {own}, 'number', {number})")
        frames.append(df.selectExpr(f"inline(array({', '.join(rows)}))"))
    categories = numbers.join(catalog.select("table", "column", "category"), ["table", "column"]).select("number", "category")
    # One row per column, as many as the driver has names of.
    return union_all(frames).distinct().join(F.broadcast(categories), "number"), numbers


def signatures(tables: Mapping[str, DataFrame], catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held_by, keys): how many values exactly these columns hold; and the columns by number."""
    values, numbers = _values(tables, catalog)
    holders = values.groupBy("category", *PARTS, "own").agg(F.sort_array(F.collect_list("number")).alias("held_by"))
    return holders.groupBy("held_by").agg(F.count(F.lit(1)).alias("keys")), numbers


def prefix_candidates(held: DataFrame, numbers: DataFrame, min_join: float) -> DataFrame:
    """(first, second, n_first, n_second): pairs that may reach the Jaccard score ``min_join``, and no other can.

    Values are ordered by the number of columns that hold them. A column of n
    values shares at least ``min_join`` of them with any partner, so one of
    its first n - ceil(min_join * n) + 1; values of equal rank are all taken.
    """
    each = held.selectExpr("explode(held_by) AS number", "size(held_by) AS spread", "keys", "held_by")
    levels = each.groupBy("number", "spread").agg(F.sum("keys").alias("keys"))
    total = "sum(keys) OVER (PARTITION BY number)"
    levels = levels.selectExpr("number", "spread", f"{total} AS n", "sum(keys) OVER (PARTITION BY number ORDER BY spread) AS upto")
    levels = levels.where(f"upto >= least(n, n - ceil({min_join}D * n - {SLACK}D) + 1)")
    cuts = levels.groupBy("number").agg(F.min("spread").alias("last"), F.max("n").alias("n"))
    cuts = cuts.join(numbers.select("number", "table"), "number")
    prefixes = each.where("spread > 1").select("number", "spread", "held_by").join(cuts, "number").where("spread <= last")
    met = prefixes.groupBy("held_by").agg(F.sort_array(F.collect_list(F.struct("number", "table", "n"))).alias("met"))
    pairs = met.where("size(met) > 1").selectExpr("explode(flatten(transform(met, (x, i) -> transform(slice(met, i + 2, size(met)), y -> struct(x, y))))) AS p")
    close = f"least(p.x.n, p.y.n) >= {min_join}D * greatest(p.x.n, p.y.n) - {SLACK}D"
    apart = pairs.where(f"p.x.table <> p.y.table AND {close}")
    return apart.selectExpr("p.x.number AS first", "p.y.number AS second", "p.x.n AS n_first", "p.y.n AS n_second").distinct()


def lake_overlap(tables: Mapping[str, DataFrame], catalog: DataFrame, min_join: float = 0.45) -> DataFrame:
    """Pairs of columns of different tables and equal category whose Jaccard score reaches ``min_join``.

    Result: (left_table, left_column, right_table, right_column, matches, total,
    join_score), tables in the order of their names. A missing value counts as a
    value of its column and matches nothing. ``catalog`` has (table, column,
    category). Every table is scanned once; the rows behind all further steps
    are sets of columns that hold a value together, not values.
    """
    if not 0 < min_join <= 1:
        raise ValueError("min_join must be above 0 and at most 1")
    held, numbers = signatures(tables, catalog)
    held = written(held)
    candidates = written(prefix_candidates(held, numbers, min_join))
    seen = held.where("size(held_by) > 1").selectExpr("held_by", "keys", "explode(held_by) AS first").join(candidates, "first")
    common = seen.where("array_contains(held_by, second)").groupBy("first", "second", "n_first", "n_second")
    scored = common.agg(F.sum("keys").alias("matches")).selectExpr(
        "first", "second", "matches", "n_first + n_second - matches AS total", "matches / CAST(n_first + n_second - matches AS DOUBLE) AS join_score"
    )
    for side, name in (("first", "left"), ("second", "right")):
        own = numbers.selectExpr(f"number AS {side}", f"table AS {name}_table", f"column AS {name}_column")
        scored = scored.join(own, side)
    columns = ["left_table", "left_column", "right_table", "right_column", "matches", "total", "join_score"]
    return scored.where(f"join_score >= {min_join}D").select(*columns)
