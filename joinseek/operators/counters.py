"""Counter columns: almost unique numbers that mostly rise by the same step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinseek.functions.values import is_missing
from joinseek.operators.neighbourhood import ROW_BITS
from joinseek.operators.profile import union_all
from joinseek.session import checkpoint, local_table, quoted


def useful_columns(report: DataFrame) -> DataFrame:
    """The columns that take part in a mergeable candidate, per side."""
    merged = report.where("mergeable")
    sides = [
        merged.select(
            "left_table",
            "right_table",
            F.lit(side).alias("side"),
            F.col(f"{side}_table").alias("table"),
            F.explode(side).alias("column"),
        )
        for side in ("left", "right")
    ]
    return sides[0].unionAll(sides[1]).distinct()


def mode_count(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of the most frequent value, 0 if there is none; NaN counts as null."""
    if isinstance(df.schema[value].dataType, (T.FloatType, T.DoubleType)):
        df = df.withColumn(value, F.expr(f"IF(isnan({quoted(value)}), NULL, {quoted(value)})"))
    counts = df.groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.coalesce(F.max("count"), F.lit(0).cast("bigint")).alias("mode_count"))


def _kind(dtype: T.DataType) -> str:
    """The type in which values of a column are subtracted without loss."""
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    return "bigint" if isinstance(dtype, T.IntegralType) else "double"


def _values(df: DataFrame, names: Sequence[str], slots: Sequence[int]) -> dict[str, DataFrame]:
    """(slot, x) rows of the present values, by kind."""
    frames = {}
    kinds = [_kind(df.schema[n].dataType) for n in names]
    for kind in sorted(set(kinds)):
        entries = [
            f"named_struct('slot', {slot}, 'x', IF({is_missing(n, df.schema[n].dataType)}, NULL, CAST({quoted(n)} AS {kind})))"
            for n, slot, own in zip(names, slots, kinds, strict=True)
            if own == kind
        ]
        frames[kind] = df.selectExpr(f"inline(array({', '.join(entries)}))").where("x IS NOT NULL")
    return frames


def _misses(values: DataFrame, kind: str, partitions: int | None) -> DataFrame:
    """(slot, miss): share of sorted-order steps other than the usual one.

    Values are counted first: equal neighbours differ by 0. The distinct values of
    all columns are sorted together, in tasks of equal size. Each meets the one
    before it within its task; one row per task joins the ends of neighbouring
    tasks. A step too long for its type counts as unknown.
    """
    parts = partitions or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = values.groupBy("slot", "x").agg(F.expr("count(1) AS n"))
    ordered = counted.repartitionByRange(parts, "slot", "x").sortWithinPartitions("slot", "x")
    placed = checkpoint(ordered.withColumn("id", F.monotonically_increasing_id())).selectExpr("*", f"shiftright(id, {ROW_BITS}) AS part")
    ahead = "lag(struct(slot, x)) OVER (PARTITION BY part ORDER BY id) AS ahead"
    beside = placed.selectExpr("slot", "x", ahead)
    ends = placed.groupBy("part").agg(
        *(F.expr(f"min_by({c}, id) AS {c}") for c in ("slot", "x")), *(F.expr(f"max_by({c}, id) AS last_{c}") for c in ("slot", "x"))
    )
    seams = ends.selectExpr("slot", "x", "lag(struct(last_slot AS slot, last_x AS x)) OVER (ORDER BY part) AS ahead")
    repeats = placed.where("n > 1").selectExpr("slot", f"CAST(0 AS {kind}) AS step", "n - 1 AS times")
    steps = beside.unionAll(seams).where("ahead.slot = slot").selectExpr("slot", "try_subtract(x, ahead.x) AS step", "1L AS times").unionAll(repeats)
    per_step = steps.groupBy("slot", "step").agg(F.sum("times").alias("times"))
    return per_step.groupBy("slot").agg(F.expr("1 - max(times) / CAST(sum(times) AS DOUBLE) AS miss"))


def counter_columns(
    tables: Mapping[str, DataFrame],
    catalog: DataFrame,
    columns: DataFrame | None = None,
    min_uniqueness: float = 0.99,
    max_miss: float = 0.1,
    partitions: int | None = None,
) -> DataFrame:
    """(table, column, uniqueness, miss, is_counter) for the given columns.

    ``catalog`` must hold distinct counts. Only numerical columns that pass the
    uniqueness test are sorted; ``miss`` is the share of steps that differ from
    the most frequent one, null where it was not needed. ``partitions`` is the
    number of tasks that sort, by default that of shuffles.
    """
    asked = catalog if columns is None else catalog.join(columns.select("table", "column").distinct(), ["table", "column"])
    uniqueness = "coalesce(try_divide(CAST(distinct AS DOUBLE), rows), 0.0D)"
    tested = asked.selectExpr("table", "column", "category", f"{uniqueness} AS uniqueness")
    chosen = tested.where(f"category = 'Numerical' AND uniqueness >= {min_uniqueness}D").collect()
    chosen = sorted((r.table, r.column) for r in chosen)
    base = tested.select("table", "column", "uniqueness")
    if not chosen:
        return base.selectExpr("*", "CAST(NULL AS DOUBLE) AS miss", "false AS is_counter")
    frames: dict[str, list[DataFrame]] = {}
    for name in sorted({t for t, _ in chosen}):
        mine = [(slot, c) for slot, (t, c) in enumerate(chosen) if t == name]
        found = _values(tables[name], [c for _, c in mine], [s for s, _ in mine])
        for kind, frame in found.items():
            frames.setdefault(kind, []).append(frame)
    misses = union_all([_misses(union_all(parts), kind, partitions) for kind, parts in frames.items()])
    names = local_table(
        misses.sparkSession,
        {
            "slot": list(range(len(chosen))),
            "table": [t for t, _ in chosen],
            "column": [c for _, c in chosen],
        },
        {"slot": pa.int32(), "table": pa.string(), "column": pa.string()},
    )
    joined = base.join(names.join(misses, "slot").drop("slot"), ["table", "column"], "left")
    return joined.selectExpr("*", f"coalesce(miss <= {max_miss}D, false) AS is_counter")
