"""Column profiles: one catalogue row per (table, column)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinseek.functions.dates import DAY_FIRST, MONTH_FIRST, date_reading
from joinseek.functions.values import PARTS, TEMPORAL, is_missing, join_key, key_parts
from joinseek.session import local_table, quoted, settle, text

DATE_SHARE = 0.5

#: Tables of so many rows have their distinct values counted column by column: a narrow row per value costs more
#: than another scan of one column.
COLUMN_ROWS = 1_000_000
COLUMNS_PER_JOB = 32


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def _fixed_category(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "'Boolean'"
    return "'Numerical'" if isinstance(dtype, T.NumericType) else "CAST(NULL AS STRING)"


def _column_stats(field: T.StructField, position: int) -> str:
    """The aggregates of one column, as one struct.

    ``valid`` counts values that read as dates, under the better of the
    day-first and month-first orders.
    """
    value, average, valid = quoted(field.name), "CAST(NULL AS DOUBLE)", "0L"
    if isinstance(field.dataType, T.StringType):
        average = f"avg(length({value}))"
        orders = (f"count_if(__date_reading{position} & {order} > 0)" for order in (DAY_FIRST, MONTH_FIRST))
        valid = f"greatest({', '.join(orders)})"
    elif isinstance(field.dataType, TEMPORAL):
        valid = f"count({value})"
    return (
        f"named_struct('column', {text(field.name)}, 'position', {position}, "
        f"'type', {text(field.dataType.simpleString())}, 'fixed', {_fixed_category(field.dataType)}, "
        f"'missing', count_if({is_missing(field.name, field.dataType)}), 'valid', {valid}, 'avg_length', {average})"
    )


def _table_stats(table: str, df: DataFrame) -> DataFrame:
    stats = ", ".join(_column_stats(field, i) for i, field in enumerate(df.schema.fields))
    readings = [
        f"{date_reading(quoted(field.name))} AS __date_reading{i}"
        for i, field in enumerate(df.schema.fields)
        if isinstance(field.dataType, T.StringType)
    ]
    one_row = df.selectExpr(*map(quoted, df.columns), *readings).agg(
        F.expr("count(1) AS rows"), F.expr(f"array({stats}) AS stats")
    )
    return one_row.selectExpr(f"{text(table)} AS table", "rows", "inline(stats)")


# Boolean and Numerical by type; Date if over half of all rows are dates.
CATEGORY = f"coalesce(fixed, CASE WHEN valid > rows * {DATE_SHARE} THEN 'Date' ELSE 'Text' END)"


def column_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count, missing values, category and mean length of every column.

    One aggregation per table with no shuffle beyond the partial results; all
    tables run in the same job.
    """
    stats = union_all([_table_stats(name, df) for name, df in tables.items()])
    kept = ["table", "column", "position", "type", "category", "rows", "missing", "avg_length"]
    categorised = stats.withColumn("category", F.expr(CATEGORY))
    return categorised.selectExpr(*kept, "CASE WHEN category = 'Text' THEN avg_length END AS avg_chars")


def _slot_values(fields: Sequence[T.StructField], slots: Sequence[int], df: DataFrame) -> DataFrame:
    """Every present value of the given columns as a narrow row (slot, l, d, s)."""
    entries, prepared = [], []
    for field, slot in zip(fields, slots, strict=True):
        parts = key_parts(field.name, field.dataType)
        prepared += [f"{value} AS {p}{slot}" for p, value in parts.items()]
        values = (f"'{p}', {f'{p}{slot}' if p in parts else f'CAST(NULL AS {kind})'}" for p, kind in PARTS.items())
        entries.append(f"named_struct('slot', {slot}, {', '.join(values)})")
    exploded = df.selectExpr(*prepared).selectExpr(f"inline(array({', '.join(entries)}))")
    return exploded.where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")


def _column_counts(df: DataFrame, fields: Sequence[T.StructField], slots: Sequence[int]) -> list[DataFrame]:
    """(slot, distinct), column by column: every column is scanned and shuffled alone, as its own type."""
    frames, one = [], F.count(F.lit(1))
    for field, slot in zip(fields, slots, strict=True):
        rows = df.select(quoted(field.name))
        if isinstance(field.dataType, TEMPORAL):
            # Times are written as text once per value, not once per row.
            rows = rows.groupBy(quoted(field.name)).agg(one.alias("n"))
        parts = key_parts(field.name, field.dataType)
        values = rows.selectExpr(*(f"{value} AS {p}" for p, value in parts.items()))
        # With a count Spark groups by its fast map, which it does not use for plain distinct rows.
        each = values.groupBy(*parts).agg(one.alias("n"))
        # Not a filter before: Spark would test the text of every row.
        present = F.expr(f"count_if({' OR '.join(f'{p} IS NOT NULL' for p in parts)}) AS distinct")
        frames.append(each.agg(present).selectExpr(f"{slot} AS slot", "distinct"))
    jobs = [frames[i : i + COLUMNS_PER_JOB] for i in range(0, len(frames), COLUMNS_PER_JOB)]
    return [settle(union_all(job)) for job in jobs]


def distinct_counts(
    tables: Mapping[str, DataFrame],
    columns: Sequence[tuple[str, str]] | None = None,
    rows: Mapping[str, int] | None = None,
) -> DataFrame:
    """Distinct non-missing values per column: (table, column, distinct).

    All columns of all tables share one shuffle of narrow rows, de-duplicated
    before it, so the cost is linear in the number of columns and a hot value
    travels at most once per task. Tables known by ``rows`` to have ``COLUMN_ROWS``
    rows or more are scanned once per column instead.
    """
    wanted = [(t, f) for t, df in tables.items() for f in df.schema.fields]
    if columns is not None:
        keep = set(columns)
        wanted = [(t, f) for t, f in wanted if (t, f.name) in keep]
    frames, found = [], []
    for name, df in tables.items():
        mine = [(slot, f) for slot, (t, f) in enumerate(wanted) if t == name]
        if mine and (rows or {}).get(name, 0) >= COLUMN_ROWS:
            found += _column_counts(df, [f for _, f in mine], [s for s, _ in mine])
        elif mine:
            frames.append(_slot_values([f for _, f in mine], [s for s, _ in mine], df))
    if frames:
        found.append(union_all(frames).distinct().groupBy("slot").agg(F.count(F.lit(1)).alias("distinct")))
    counts = union_all(found)
    names = local_table(
        counts.sparkSession,
        {"slot": list(range(len(wanted))), "table": [t for t, _ in wanted], "column": [f.name for _, f in wanted]},
        {"slot": pa.int32(), "table": pa.string(), "column": pa.string()},
    )
    # One row per column on both sides.
    return names.join(F.broadcast(counts), "slot", "left").selectExpr("table", "column", "coalesce(distinct, 0L) AS distinct")


def profile(tables: Mapping[str, DataFrame], distinct: bool = True) -> DataFrame:
    """The catalogue: category, missing, distinct and mean length per column."""
    stats = column_stats(tables)
    if not distinct:
        return stats.withColumn("distinct", F.lit(None).cast("bigint"))
    return add_distinct(settle(stats), tables)


def add_distinct(catalog: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The catalogue with its distinct counts (re)computed for its own columns."""
    listed = catalog.select("table", "column", "rows").collect()
    catalog = catalog.drop("distinct")
    if not listed:
        return catalog.withColumn("distinct", F.lit(None).cast("bigint"))
    counts = distinct_counts(tables, [(r.table, r.column) for r in listed], {r.table: r.rows for r in listed})
    return catalog.join(counts, ["table", "column"], "left")


#: Sketches of 2 to this power registers; their standard error is 1.04 / 64, and ``SKETCH_ERROR`` three of it.
SKETCH_BITS = 12
SKETCH_ERROR = 0.05


def sketch_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, column, position, rows, missing, sketch): distinct values as sketches that can be merged.

    One scan per table without a shuffle of values. For first looks and for tables
    that grow by parts; scores and pruning use exact counts.
    """
    frames = []
    for name, df in tables.items():
        stats = []
        for position, field in enumerate(df.schema):
            value, missing = join_key(field.name, field.dataType), is_missing(field.name, field.dataType)
            stats.append(
                f"named_struct('column', {text(field.name)}, 'position', {position}, 'missing', count_if({missing}), "
                f"'sketch', hll_sketch_agg(IF({missing}, NULL, {value}), {SKETCH_BITS}))"
            )
        one_row = df.agg(F.expr("count(1) AS rows"), F.expr(f"array({', '.join(stats)}) AS stats"))
        frames.append(one_row.selectExpr(f"{text(name)} AS table", "rows", "inline(stats)"))
    return union_all(frames).select("table", "column", "position", "rows", "missing", "sketch")


def merged_sketches(catalogs: Sequence[DataFrame]) -> DataFrame:
    """One catalogue from those of disjoint parts of the same tables."""
    together = union_all(list(catalogs)).groupBy("table", "column", "position")
    return together.agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.expr("hll_union_agg(sketch) AS sketch"))


def sketched_distinct(catalog: DataFrame) -> DataFrame:
    """A catalogue of sketches with ``distinct``, an estimate good to about ``SKETCH_ERROR``."""
    return catalog.withColumn("distinct", F.expr("hll_sketch_estimate(sketch)")).drop("sketch")


def group_by_category(catalog: DataFrame) -> DataFrame:
    """Columns of each category per table, in table order."""
    return catalog.groupBy("table", "category").agg(
        F.expr("array_sort(collect_list(struct(position, column))).column AS columns")
    )


def shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")
            )
            for name, df in tables.items()
        ]
    )
