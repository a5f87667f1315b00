"""Sorted neighbourhood: row pairs whose keys stand close in the sorted order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinseek.functions.values import is_missing, join_key
from joinseek.session import checkpoint, quoted

ROW_BITS = 33  # monotonically_increasing_id keeps the row number in these bits


def sort_key(name: str, own: T.DataType, other: T.DataType) -> str:
    """The value in a type both sides can be sorted by."""
    if isinstance(own, T.IntegralType) and isinstance(other, T.IntegralType):
        return f"CAST({quoted(name)} AS BIGINT)"
    if isinstance(own, T.NumericType) and isinstance(other, T.NumericType):
        return f"CAST({quoted(name)} AS DOUBLE) + 0.0D"
    return join_key(name, own)


def global_rank(keys: DataFrame, key: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """``keys`` with their ``rank`` 1, 2, 3 ... in the order of the distinct ``key`` columns.

    Rows are range-partitioned and sorted inside partitions, never in one task.
    The row number within the partition is then shifted by the row count of the
    partitions before it, one small row per partition.
    """
    spark = keys.sparkSession
    order = [key] if isinstance(key, str) else list(key)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = checkpoint(
        keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ).select(
        *keys.columns,
        F.shiftright("id", ROW_BITS).alias("part"),
        F.col("id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"),
    )
    # One row per partition, so this window is small whatever the data size.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("part").count()
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    ranked = numbered.join(F.broadcast(offsets), "part")
    return ranked.select(*keys.columns, (F.col("offset") + F.col("row") + 1).alias("rank"))


def sorted_neighbourhood(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    window: int = 9,
    partitions: int | None = None,
) -> DataFrame:
    """Pairs of distinct tuples that a sorted neighbourhood of this width compares.

    The first columns must stand at most ``(window - 1) / 2`` places apart among
    the sorted distinct values of both sides; the other columns must be equal.
    Result: ``left_0.., right_0..`` and ``exact``, true if all columns are equal.

    Places are cut into bands as wide as the window; a left tuple goes to the one
    or two bands its neighbours can be in, and the join is on band and block
    columns. A band holds at most one tuple per place and block on either side,
    so no group grows with the data, however many rows share a value.
    """
    if window < 1 or window % 2 == 0:
        raise ValueError("the window must be an odd number")
    reach = (window - 1) // 2
    width = len(left_on)

    def distinct_tuples(df: DataFrame, names: Sequence[str], other: T.DataType, side: str) -> DataFrame:
        own = df.schema[names[0]].dataType
        keys = [sort_key(names[0], own, other), *(join_key(n, df.schema[n].dataType) for n in names[1:])]
        present = df.where(f"NOT {is_missing(names[0], own)}")
        return present.selectExpr(*(f"{k} AS {side}_{i}" for i, k in enumerate(keys))).distinct()

    a = distinct_tuples(left, left_on, right.schema[right_on[0]].dataType, "left")
    b = distinct_tuples(right, right_on, left.schema[left_on[0]].dataType, "right")
    keys = a.select(F.col("left_0").alias("key")).unionAll(b.select(F.col("right_0").alias("key"))).distinct()
    ranks = global_rank(keys, "key", partitions)
    bands = f"array_distinct(array((rank - {reach}) div {window}, (rank + {reach}) div {window}))"
    placed = a.join(ranks, a["left_0"] == ranks["key"]).selectExpr(*a.columns, "rank AS place", f"explode({bands}) AS band")
    facing = b.join(ranks, b["right_0"] == ranks["key"]).selectExpr(*b.columns, "rank", f"rank div {window} AS own_band")
    condition = (F.col("band") == F.col("own_band")) & (F.abs(F.col("place") - F.col("rank")) <= reach)
    for i in range(1, width):
        condition = condition & F.col(f"left_{i}").eqNullSafe(F.col(f"right_{i}"))
    exact = F.lit(True)
    for i in range(width):
        exact = exact & (F.col(f"left_{i}") == F.col(f"right_{i}"))
    pairs = placed.join(facing, condition)
    return pairs.select(*a.columns, *b.columns, F.coalesce(exact, F.lit(False)).alias("exact"))
