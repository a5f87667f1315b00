"""Path similarity of words in an is-a taxonomy given as two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.session import checkpoint, written


@dataclass(frozen=True)
class Taxonomy:
    """``senses(word, sense)`` and ``isa(child, parent)``, both over sense ids."""

    senses: DataFrame
    isa: DataFrame


def ancestors(isa: DataFrame) -> DataFrame:
    """(sense, ancestor, steps): every ancestor with its fewest steps up.

    Known paths are joined end to end, so their length doubles each round and a
    taxonomy of depth 20 takes five. The round that finds no path as long as it
    could ends the search, which cycles do not prevent.
    """
    paths = isa.selectExpr("child AS sense", "parent AS ancestor", "1 AS steps").where("child != parent").distinct()
    paths, reach = checkpoint(paths), 1
    while (paths.agg(F.max("steps")).first()[0] or 0) == reach:
        upper = paths.selectExpr("sense AS ancestor", "ancestor AS higher", "steps AS more")
        longer = paths.join(upper, "ancestor").selectExpr("sense", "higher AS ancestor", "steps + more AS steps")
        every = paths.unionAll(longer.where("sense != ancestor"))
        paths, reach = checkpoint(every.groupBy("sense", "ancestor").agg(F.min("steps").alias("steps"))), 2 * reach
    return paths


def semantic_similarity(
    pairs: DataFrame, taxonomy: Taxonomy, first: str = "first", second: str = "second", score: str = "score"
) -> DataFrame:
    """Best ``1 / (1 + shortest path)`` over the senses of two words, else 0.

    The path leads over a common ancestor. A similarity never exceeds that of a
    word with itself, which is at most 1, so it needs no further scaling. Only
    ancestors of words of both sides are met. Words of a side that have the same of
    these at the same distances share a profile, named by the least of them; a pair
    of profiles climbs once, however many pairs of words have it. It meets by word
    and ancestor, so the root of the taxonomy never gathers all words in one group.
    """
    senses = taxonomy.senses.select(F.lower("word").alias("word"), "sense").distinct()
    words = written(pairs.select(first, second).distinct())
    closure = ancestors(taxonomy.isa).join(senses, "sense").select("word", "ancestor", "steps")
    own = senses.selectExpr("word", "sense AS ancestor", "0 AS steps")
    nearest = written(closure.unionAll(own).groupBy("word", "ancestor").agg(F.min("steps").alias("steps")))
    asked = [nearest.join(words.select(F.lower(c).alias("word")).distinct(), "word", "left_semi") for c in (first, second)]
    ancestor = [df.select("ancestor").distinct() for df in asked]
    shared = [written(df.join(met, "ancestor", "left_semi")) for df, met in zip(asked, reversed(ancestor), strict=True)]
    profiled = words
    for df, column, name in zip(shared, (first, second), ("__one", "__two"), strict=True):
        named = _profiles(df).withColumnRenamed("profile", name)
        profiled = profiled.join(named, F.lower(column) == named["word"], "left").drop("word")
    profiled = written(profiled)
    up = shared[0].selectExpr("word AS __one", "ancestor", "steps AS up")
    down = shared[1].selectExpr("word AS __two", "ancestor", "steps AS down")
    met = profiled.select("__one", "__two").distinct().join(up, "__one").join(down, ["__two", "ancestor"])
    best = written(met.groupBy("__one", "__two").agg(F.min(F.expr("up + down")).alias("__path")))
    scored = profiled.join(best, ["__one", "__two"], "left")
    return scored.select(first, second, F.coalesce(1.0 / (1 + F.col("__path")), F.lit(0.0)).alias(score))


def _profiles(nearest: DataFrame) -> DataFrame:
    """(word, profile): the least word with the same ancestors at the same distances."""
    listed = nearest.groupBy("word").agg(F.expr("array_sort(collect_list(struct(ancestor, steps))) AS reached"))
    listed = written(listed)
    named = listed.groupBy("reached").agg(F.min("word").alias("profile"))
    return listed.join(named, "reached").select("word", "profile")
