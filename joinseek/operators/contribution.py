"""What a join adds to each side, and the join itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinseek.functions.values import FRACTIONAL, is_missing, join_key
from joinseek.operators.keyrows import KeyLayout
from joinseek.operators.overlap import CANDIDATE
from joinseek.operators.profile import union_all
from joinseek.session import column, local_table, quoted

BIG = "decimal(38,0)"


def _any_value(df: DataFrame, keys: Sequence[str], complete: set[str]) -> str:
    """True if a column outside the key has a value.

    One complete column there settles it, and no other has to be read.
    """
    free = [f for f in df.schema.fields if f.name not in keys]
    if any(f.name in complete for f in free):
        return "true"
    return " OR ".join(f"NOT {is_missing(f.name, f.dataType)}" for f in free) or "false"


def join_contribution(
    tables: Mapping[str, DataFrame], candidates: DataFrame, catalog: DataFrame | None = None
) -> DataFrame:
    """Percentage of information each side gains from the join on a candidate.

    The right side adds (its non-key columns) x (joined rows in which one of them
    has a value), relative to the cells of the left table; the left side likewise.
    Missing key values join with each other.

    The join is never built: rows are counted per key, before the shuffle already,
    and the counts of both sides multiplied. A key with a third of all rows is one
    row per task. With a ``catalog`` that knows columns without missing values,
    only the key columns are read.
    """
    complete: dict[str, set[str]] = {name: set() for name in tables}
    if catalog is not None:
        for row in catalog.where("missing = 0").select("table", "column").collect():
            complete[row.table].add(row.column)
    rows = candidates.select(*CANDIDATE).distinct().collect()
    rows = sorted(rows, key=lambda r: (r.left_table, r.right_table, r.left, r.right))
    spark = candidates.sparkSession
    types = {
        "id": pa.int32(),
        "left_table": pa.string(),
        "right_table": pa.string(),
        "left": pa.list_(pa.string()),
        "right": pa.list_(pa.string()),
        "cols_left": pa.int64(),
        "cols_right": pa.int64(),
    }
    described = local_table(
        spark,
        {
            "id": list(range(len(rows))),
            **{c: [r[c] for r in rows] for c in CANDIDATE},
            "cols_left": [len(tables[r.left_table].columns) for r in rows],
            "cols_right": [len(tables[r.right_table].columns) for r in rows],
        },
        types,
    )
    sums = _sums(tables, rows, complete) if rows else described.select("id", *(F.lit(0).alias(c) for c in SUMS)).limit(0)
    joined = described.join(sums, "id", "left").na.fill(0, list(SUMS))

    def percent(own: str, other: str) -> str:
        gained = f"(cols_{other} - size({other})) * CAST({other}_filled AS DOUBLE) * 100"
        cells = f"CAST(rows_{own} AS DOUBLE) * cols_{own}"
        return f"coalesce(try_divide({gained}, {cells}), 0.0D) AS {other}_adds"

    return joined.selectExpr(
        *CANDIDATE, f"CAST(joined_rows AS {BIG}) AS joined_rows", percent("left", "right"), percent("right", "left")
    )


SUMS = ("rows_left", "rows_right", "joined_rows", "right_filled", "left_filled")


def _sums(tables: Mapping[str, DataFrame], rows: Sequence, complete: Mapping[str, set[str]]) -> DataFrame:
    sides = [
        (i, side, (r[f"{side}_table"], tuple(r[side]))) for i, r in enumerate(rows) for side in ("left", "right")
    ]
    layout = KeyLayout(tables, [column_set for _, _, column_set in sides])
    frames = []
    for name, df in tables.items():
        keys, flags = [], {}
        for number, side, column_set in sides:
            if column_set[0] != name:
                continue
            flag = f"f{len(flags)}"
            flags[flag] = f"IF({_any_value(df, column_set[1], complete[name])}, 1L, 0L)"
            counts = ["1L", flag, "0L", "0L"] if side == "left" else ["0L", "0L", "1L", flag]
            named = dict(zip(("nl", "el", "nr", "er"), counts, strict=True))
            keys.append((column_set, {"id": str(number), **named}))
        if keys:
            frames.append(layout.rows(df, keys, flags))
    per_key = (
        union_all(frames)
        .groupBy("id", *layout.names)
        .agg(*(F.sum(c).alias(c) for c in ("nl", "el", "nr", "er")))
    )

    def product(a: str, b: str) -> str:
        return f"sum(CAST({a} AS DECIMAL(19,0)) * CAST({b} AS DECIMAL(19,0)))"

    measures = ["sum(nl)", "sum(nr)", product("nl", "nr"), product("nl", "er"), product("el", "nr")]
    return per_key.groupBy("id").agg(*(F.expr(f"{m} AS {n}") for m, n in zip(measures, SUMS, strict=True)))


def _native_key(name: str, own: T.DataType, left: T.DataType, right: T.DataType) -> str | None:
    """The key in a type both sides have, or null if they must meet as text."""
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return quoted(name) if left == right else f"CAST({quoted(name)} AS BIGINT)"
    if left != right or isinstance(own, (T.MapType, T.ArrayType, T.StructType)):
        return None
    if isinstance(own, FRACTIONAL):
        return f"IF(isnan({quoted(name)}), NULL, {quoted(name)})"
    return quoted(name)


def join_on(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """The inner join on a candidate; names both sides use get ``_left``/``_right``.

    Missing key values join with each other, so k rows without a key on either
    side give k x k rows; filter them out before where that is not wanted. Keys of
    one type are compared as they are and only the others as text. The sort-merge
    join lets adaptive execution split a skewed key.
    """
    clash = set(left.columns) & set(right.columns)
    pairs = [(left.schema[a].dataType, right.schema[b].dataType) for a, b in zip(left_on, right_on, strict=True)]

    def renamed(df: DataFrame, suffix: str, keys: Sequence[str], prefix: str) -> DataFrame:
        own = [df.schema[k].dataType for k in keys]
        parts = [
            F.expr(_native_key(k, dtype, *both) or join_key(k, dtype)).alias(f"{prefix}{i}")
            for i, (k, dtype, both) in enumerate(zip(keys, own, pairs, strict=True))
        ]
        return df.select(*(column(c).alias(c + suffix if c in clash else c) for c in df.columns), *parts)

    a, b = renamed(left, "_left", left_on, "__l"), renamed(right, "_right", right_on, "__r")
    condition = F.lit(True)
    for i in range(len(left_on)):
        condition = condition & a[f"__l{i}"].eqNullSafe(b[f"__r{i}"])
    extra = [f"__{s}{i}" for s in "lr" for i in range(len(left_on))]
    return a.join(b, condition).drop(*extra)
