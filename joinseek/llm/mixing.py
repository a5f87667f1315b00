"""Mixing sources to target weights: hierarchical token budgets and seeded epochs.

Weights form a tree of domain, language and source. A token budget is handed
down from the root. A node that cannot use its share, even with the allowed
number of epochs, passes what is left to its siblings in proportion to their
weights; only what a whole family cannot use goes to the families beside it. A
leaf then takes its budget from a stream of epochs, each in an order of its own.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.llm.text import kept_table, words
from joinseek.session import quoted, text

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixParams:
    """``weights`` per level by name; names not listed weigh ``other``.

    ``domain_rule`` is SQL text over the documents. ``budget`` is a number of
    tokens, or a share of all tokens if it is below 1. The place where the budget
    of a leaf ends is searched in ``steps`` steps, each of which tells 256 parts
    of the order apart; only the last part of a leaf is sorted.
    """

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    other: float = 1.0
    domain_rule: str = "''"
    budget: float = 0.5
    max_epochs: int = 3
    seed: str = "mix"
    steps: int = 2


def _weight(level: str, params: MixParams) -> str:
    listed = params.weights.get(level, {})
    cases = " ".join(f"WHEN {level} = {text(name)} THEN {float(w)}D" for name, w in listed.items())
    return f"CASE {cases} ELSE {float(params.other)}D END" if cases else f"{float(params.other)}D"


def shared_out(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """``nodes`` (…, weight, capacity, budget of the parent) with their own ``budget``.

    Shares are filled in the order of capacity per weight: a node whose share
    exceeds its capacity takes that, the rest is dealt among the others. Nodes of
    weight 0 get nothing. One window over the children of each parent.
    """
    group = ", ".join(parent) if parent else "1"
    order = f"PARTITION BY {group} ORDER BY IF(weight > 0, try_divide(capacity, weight), -1D), {level}"
    before = f"coalesce(sum(IF(weight > 0, capacity, 0D)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
    left = f"sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    levels = nodes.selectExpr("*", f"try_divide(budget - {before}, {left}) AS __rate")
    rate = f"max(__rate) OVER (PARTITION BY {group})"
    given = f"IF(weight > 0, least(capacity, greatest(0D, {rate} * weight)), 0D)"
    return levels.selectExpr(*(quoted(c) for c in nodes.columns if c != "budget"), f"{given} AS budget")


def leaf_budgets(leaves: DataFrame, params: MixParams) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens).

    The tree has as many nodes as the corpus has sources; every level is a
    window over the children of one parent.
    """
    # What a weight of 0 keeps from being used is no capacity of the nodes above.
    usable = " AND ".join(f"{_weight(level, params)} > 0" for level in LEVELS)
    capacity = f"IF({usable}, CAST(tokens * {params.max_epochs} AS DOUBLE), 0D) AS capacity"
    leaves = leaves.selectExpr(*LEVELS, "tokens", capacity)
    total = leaves.agg(F.sum("tokens").alias("t")).first().t or 0
    budget = params.budget * total if params.budget < 1 else float(params.budget)
    above = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", F.expr(_weight(level, params)))
        parent = path[:-1]
        nodes = nodes.withColumn("budget", F.lit(float(budget))) if above is None else nodes.join(above, parent)
        above = shared_out(nodes, parent, level).select(*path, "budget")
    return leaves.join(above, list(LEVELS)).selectExpr(
        *LEVELS, "tokens", "CAST(floor(budget + 0.000001D) AS BIGINT) AS budget"
    )


def _leaf_columns(params: MixParams) -> list[Column]:
    return [
        F.expr(f"coalesce({params.domain_rule}, '')").alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    ]


def _order(key: str, mark: str, params: MixParams) -> str:
    """The place of a document in the epoch that its leaf does not finish.

    It is drawn from the key and the digest of the text, so rows that share a key
    have places of their own unless they are equal.
    """
    return f"md5(concat_ws(':', {text(params.seed)}, CAST(full AS STRING), CAST({key} AS STRING), lower(hex({mark}))))"


def _mark(body: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(quoted(body)), F.lit(""))))


def _ends(sized: DataFrame, params: MixParams) -> tuple[DataFrame, DataFrame]:
    """Where every leaf's budget ends, and the documents of the part in which it does.

    The first table has (domain, lang, source, full, rest, part, before) per
    leaf: so many whole epochs and the rest of the budget, the part of the next
    epoch's order in which it ends and the tokens before that part. The second has
    (domain, lang, source, place, each, took, split) for the documents of that part
    which begin within the rest: the tokens of one, those that all rows of the place
    take together, and whether that is less than all of several equal rows.
    """
    leaves = sized.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    ends = leaf_budgets(leaves, params).selectExpr(
        *LEVELS,
        "CAST(budget div greatest(tokens, 1L) AS INT) AS full",
        "budget % greatest(tokens, 1L) AS rest",
        "'' AS part",
        "0L AS before",
    )
    ends = kept_table(ends, "leaves")
    leaf = ", ".join(LEVELS)
    state = [*LEVELS, "full", "rest"]
    for step in range(1, params.steps + 1):
        within = sized.join(ends.where("rest > 0"), list(LEVELS)).selectExpr("*", f"{_order('key', 'mark', params)} AS place")
        parts = within.where("startswith(place, part)").groupBy(*state, "before", F.substring("place", 1, 2 * step).alias("part"))
        upto = f"before + sum(t) OVER (PARTITION BY {leaf} ORDER BY part)"
        passed = parts.agg(F.sum("n_tokens").alias("t")).selectExpr(*state, "part", f"{upto} AS upto", "t").where("upto > rest")
        last = passed.groupBy(*state).agg(F.min(F.struct("part", F.expr("upto - t AS before"))).alias("end"))
        ends = kept_table(last.select(*state, "end.*").unionAll(ends.where("rest = 0")), "ends")
    within = sized.join(ends.where("rest > 0"), list(LEVELS)).selectExpr("*", f"{_order('key', 'mark', params)} AS place")
    inside = within.where("startswith(place, part)").groupBy(*LEVELS, "rest", "before", "place")
    since = f"before + sum(t) OVER (PARTITION BY {leaf} ORDER BY place ROWS UNBOUNDED PRECEDING) - t"
    inside = inside.agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("each"), F.count(F.lit(1)).alias("n"))
    taken = inside.selectExpr(*LEVELS, "place", "rest", "t", "each", "n", f"{since} AS since").where("since < rest")
    taken = taken.selectExpr(*LEVELS, "place", "each", "least(t, rest - since) AS took", "n > 1 AND t > rest - since AS split")
    return ends, kept_table(taken, "taken")


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Equal rows with their ``number`` from 0 within ``by``; counted per part of the table, then over the parts."""
    placed = kept_table(rows.withColumn("__id", F.monotonically_increasing_id()), "equal-rows").withColumn("__part", F.shiftright("__id", 33))
    group = ", ".join(by)
    counts = placed.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("n"))
    earlier = f"coalesce(sum(n) OVER (PARTITION BY {group} ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS earlier"
    own = placed.selectExpr("*", f"row_number() OVER (PARTITION BY {group}, __part ORDER BY __id) - 1 AS own")
    numbered = own.join(counts.selectExpr(*by, "__part", earlier), [*by, "__part"])
    return numbered.selectExpr(*(quoted(c) for c in rows.columns), "earlier + own AS number")


def _copied(rows: DataFrame, ends: DataFrame, taken: DataFrame, params: MixParams) -> DataFrame:
    """``rows`` (…, __key, __mark, __domain, __lang, __source, __tokens) once per copy, with __epoch and __taken.

    Both tables are as small as the tree of sources, so the rows stay where they
    are; with very many sources Spark shuffles instead. Where a budget ends among
    equal rows, these are numbered, and each takes what the ones before it leave.
    """
    names = [f"__{level}" for level in LEVELS]
    ends = ends.selectExpr(*(f"{level} AS e_{level}" for level in LEVELS), "full", "rest", "part")
    taken = taken.selectExpr(*(f"{level} AS t_{level}" for level in LEVELS), "place AS t_place", "each", "took", "split")
    placed = rows.join(ends, [F.col(n) == F.col(f"e_{level}") for n, level in zip(names, LEVELS, strict=True)])
    placed = placed.selectExpr("*", f"{_order('__key', '__mark', params)} AS place")
    same = [F.col(n) == F.col(f"t_{level}") for n, level in zip(names, LEVELS, strict=True)]
    placed = placed.join(taken, [*same, F.col("place") == F.col("t_place")], "left")
    if not taken.where("split").isEmpty():
        equal = _numbered(placed.where("split"), [*names, "place"])
        equal = equal.withColumn("took", F.expr("IF(number * each < took, least(each, took - number * each), NULL)")).drop("number")
        placed = placed.where("NOT coalesce(split, false)").unionByName(equal)
    copies = placed.selectExpr(
        "*", f"full + IF(rest > 0 AND (substring(place, 1, {2 * params.steps}) < part OR took IS NOT NULL), 1, 0) AS copies"
    )
    copies = copies.where("copies > 0").selectExpr("*", "explode(sequence(0, copies - 1)) AS __epoch")
    paid = "IF(__epoch = full, least(__tokens, coalesce(took, __tokens)), __tokens) AS __taken"
    return copies.selectExpr(*(quoted(c) for c in rows.columns), "__epoch", paid)


def _sized(docs: DataFrame, params: MixParams, key: str, body: str) -> DataFrame:
    tokens = F.size(words(F.col(quoted(body)))).cast("long").alias("n_tokens")
    return docs.select(F.col(quoted(key)).alias("key"), *_leaf_columns(params), tokens, _mark(body).alias("mark"))


def selection(docs: DataFrame, params: MixParams, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, n_taken, epoch), one row per copy chosen.

    Tokens are words. A leaf with a budget of so many whole epochs takes every
    document that often; of the next epoch it takes, in the order of a seeded
    digest, the documents that begin within the rest; ``n_taken`` is how many words
    of a copy are paid for; no leaf takes more than its budget. Rows that share a
    key, or have none, count one by one, equal rows included; which of equal rows
    is taken makes no difference. A null language or source is the empty name;
    null and empty texts have no tokens and cost nothing; a long text is one
    document like any other. An empty table gives an empty one.
    """
    sized = kept_table(_sized(docs, params, key, body), "sized")
    ends, taken = _ends(sized, params)
    rows = sized.selectExpr("key AS __key", *(f"{level} AS __{level}" for level in LEVELS), "n_tokens AS __tokens", "mark AS __mark")
    return _copied(rows, ends, taken, params).selectExpr(
        f"__key AS {quoted(key)}", *(f"__{level} AS {level}" for level in LEVELS), "__tokens AS n_tokens", "__taken AS n_taken", "__epoch AS epoch"
    )


def mixed(docs: DataFrame, params: MixParams) -> DataFrame:
    """``docs`` in the chosen proportions, a row per copy, with ``epoch`` and ``n_taken``.

    ``n_taken`` is the number of leading words that the budget pays for; it is
    less than all only for the last document of a leaf. The columns of ``docs``
    stay; those called as the two new ones are replaced. Texts are not shuffled.
    """
    sized = _sized(docs, params, "doc_id", "text")
    ends, taken = _ends(kept_table(sized, "sized"), params)
    rest = [quoted(c) for c in docs.columns if c not in ("epoch", "n_taken")]
    leaf = [c.alias(f"__{level}") for c, level in zip(_leaf_columns(params), LEVELS, strict=True)]
    rows = docs.select(*rest, F.col("doc_id").alias("__key"), _mark("text").alias("__mark"), *leaf, F.size(words(F.col("text"))).cast("long").alias("__tokens"))
    return _copied(rows, ends, taken, params).selectExpr(*rest, "__epoch AS epoch", "__taken AS n_taken")
