"""Joins whose key may be held by a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.session import quoted

#: A key is hot if more than one in so many of all rows holds it, so there are fewer hot keys than this.
HOT_SHARE = 1000


def joined_by_key(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has every key once.

    ``weight`` is the column of ``table`` that says how many of the ``total`` rows
    hold its key. Rows of hot keys meet them where they are, by a broadcast of
    fewer than ``HOT_SHARE`` rows; the others are shuffled, and none of their
    keys holds more than one in ``HOT_SHARE`` of them. Both sides are read twice
    and should be written tables. Null keys join nothing.
    """
    names = list(keys)
    is_hot = F.col(quoted(weight)) * F.lit(HOT_SHARE) > F.lit(int(total))
    hot, cold = table.where(is_hot), table.where(~is_hot)
    near = rows.join(F.broadcast(hot), names)
    rest = rows.join(F.broadcast(hot.select(*(quoted(n) for n in names))), names, "left_anti")
    return near.unionByName(rest.join(cold, names))
