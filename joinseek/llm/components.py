"""Connected components of a large set of links, by stars that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.llm.text import kept_table


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.unionAll(links.selectExpr("v AS u", "u AS v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
    return both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node is linked to the smallest of them."""
    down = links.selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u")
    moved = near.where("v <> m").selectExpr("v AS u", "m AS v")
    return moved.unionAll(least.selectExpr("u", "m AS v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); the root is the smallest node.

    Each round is written to the shared folder. Links of a node are only reduced
    to a minimum and joined, never gathered, so a node may have any number.
    """
    now = kept_table(links.selectExpr("greatest(u, v) AS u", "least(u, v) AS v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.expr("CAST(xxhash64(u, v) AS DECIMAL(38, 0))"))).first()
        if mark == seen:
            break
        seen = mark
        now = kept_table(_small_star(_large_star(now)), "links")
    roots = now.select("v").distinct().selectExpr("v AS node", "v AS root")
    return now.selectExpr("u AS node", "v AS root").unionAll(roots)
