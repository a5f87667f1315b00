"""Column pruning: predicates over the catalogue, then a projection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.session import column


def missing_ratio() -> Column:
    return F.try_divide(F.col("missing").cast("double"), F.col("rows").cast("double"))


def _split(catalog: DataFrame, keep: Column, reason: str, value: Column) -> tuple[DataFrame, DataFrame]:
    kept = F.coalesce(keep, F.lit(False))
    dropped = catalog.where(~kept).select("table", "column", F.lit(reason).alias("reason"), value.alias("value"))
    return catalog.where(kept), dropped


def prune_missing(catalog: DataFrame, max_ratio: float = 1) -> tuple[DataFrame, DataFrame]:
    """Keep columns whose share of missing values is below ``max_ratio``.

    The dropped list carries count and share. An empty table keeps nothing.
    """
    kept, dropped = _split(catalog, missing_ratio() < max_ratio, "missing values", missing_ratio())
    counts = catalog.select("table", "column", "missing")
    return kept, dropped.join(counts, ["table", "column"])


def prune_length(catalog: DataFrame, max_avg: float = 50, scope: str = "string") -> tuple[DataFrame, DataFrame]:
    """Keep columns whose mean length is below ``max_avg``.

    Scope ``string`` tests every string column (an all-null one is dropped);
    scope ``text`` tests only those of category Text and keeps unknown means.
    """
    if scope == "string":
        tested, average = F.col("type").rlike("^(string|char|varchar)"), F.col("avg_length")
        keep = ~tested | (average < max_avg)
    elif scope == "text":
        average = F.col("avg_chars")
        keep = average.isNull() | (average == 0) | (average < max_avg)
    else:
        raise ValueError(f"scope must be 'string' or 'text', not {scope!r}")
    return _split(catalog, keep, "mean length", average)


def prune_uniqueness(catalog: DataFrame, min_uniques: int = 1, min_ratio: float = 0) -> tuple[DataFrame, DataFrame]:
    """Keep columns with more than max(min_uniques, min_ratio * rows) distinct values."""
    threshold = F.greatest(F.lit(min_uniques).cast("double"), F.col("rows") * F.lit(min_ratio).cast("double"))
    keep = (threshold <= 0) | (F.col("distinct") > threshold)
    return _split(catalog, keep, "few distinct values", F.col("distinct").cast("double"))


def pair_columns(catalog: DataFrame, pairs: DataFrame) -> DataFrame:
    """Catalogue rows of both sides of every table pair, marked by ``side``."""
    sides = [
        pairs.join(catalog, F.col(f"{side}_table") == F.col("table")).withColumn("side", F.lit(side))
        for side in ("left", "right")
    ]
    return sides[0].unionAll(sides[1])


def prune_category(catalog: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per table pair, split off columns whose category the other side lacks.

    Returns two catalogues with the pair and the side on every row.
    """
    columns = pair_columns(catalog, pairs)
    key = ["left_table", "right_table", "category"]
    sides = columns.groupBy(key).agg(F.count_distinct("side").alias("sides"))
    marked = columns.join(sides, key)
    return marked.where("sides = 2").drop("sides"), marked.where("sides = 1").drop("sides")


def cardinality_discards(catalog: DataFrame, pairs: DataFrame, min_score: float) -> DataFrame:
    """Column pairs whose distinct counts rule out a Jaccard of ``min_score``."""
    counts = catalog.select("table", "column", "distinct")
    left = counts.select(*(F.col(c).alias(f"left_{c}") for c in counts.columns))
    right = counts.select(*(F.col(c).alias(f"right_{c}") for c in counts.columns))
    low = F.least("left_distinct", "right_distinct")
    high = F.greatest("left_distinct", "right_distinct")
    matched = pairs.join(left, "left_table").join(right, "right_table")
    return matched.where((low < high * F.lit(min_score)) & (F.lit(min_score) > 0))


def cardinality_kept(catalog: DataFrame, pairs: DataFrame, min_score: float) -> DataFrame:
    """Column pairs whose distinct counts allow a Jaccard of ``min_score``.

    Counts are put in bands of ratio ``min_score``. Counts within that ratio are in
    one band or in neighbouring ones, so the pairs come from an equi-join of bands
    and not from the product of all columns. Two columns without values are kept.
    """
    if not 0 < min_score < 1:
        raise ValueError("min_score must be between 0 and 1")
    band = f"IF(distinct = 0, -9, CAST(floor(-ln(distinct) / ln({min_score}D)) AS INT))"
    near = f"IF(distinct = 0, array(-9), transform(array(-1, 0, 1), i -> {band} + i))"
    fields = ["table", "column", "distinct"]
    known = catalog.where("distinct IS NOT NULL")
    left = known.selectExpr(*(f"{c} AS left_{c}" for c in fields), f"explode({near}) AS band")
    right = known.selectExpr(*(f"{c} AS right_{c}" for c in fields), f"{band} AS band")
    matched = pairs.join(left, "left_table").join(right, ["right_table", "band"]).drop("band")
    return matched.where(f"least(left_distinct, right_distinct) >= greatest(left_distinct, right_distinct) * {min_score}D")


def drop_properties(catalog: DataFrame, dropped: DataFrame) -> DataFrame:
    """The catalogue without the dropped columns."""
    return catalog.join(dropped, ["table", "column"], "left_anti")


def project(tables: Mapping[str, DataFrame], catalog: DataFrame) -> dict[str, DataFrame]:
    """The tables cut down to the catalogue's columns, in table order."""
    kept: dict[str, list[tuple[int, str]]] = {name: [] for name in tables}
    for row in catalog.select("table", "position", "column").collect():
        kept[row.table].append((row.position, row.column))
    return {name: tables[name].select(*(column(c) for _, c in sorted(cols))) for name, cols in kept.items()}
