"""Similarity joins of two string columns, without comparing every string with every other.

Both joins first find candidates by equality of keys that similar strings must
share, then test a cheap bound, and compute the similarity of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.functions.strings import jaro, levenshtein
from joinseek.session import quoted, written

SLACK = 1e-9
#: Strings of a hot key are dealt into parts of about so many.
PART = 512
#: A key of so many characters of each string is chosen while the longer string is at most so long.
CHOSEN = ((3, 24), (2, 60))


def _distinct(df: DataFrame, name: str, alias: str) -> DataFrame:
    return df.where(F.col(quoted(name)).isNotNull()).select(F.col(quoted(name)).cast("string").alias(alias)).distinct()


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides that share a key; those of a hot key are dealt into blocks of both sides.

    A key of n left and m right rows becomes about n / ``PART`` times m / ``PART``
    keys, so that no task gets more than a block of either side at once.
    """
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), keys)
    sizes = sizes.selectExpr(*keys, f"CAST(ceil(n / {PART}) AS INT) AS n_parts", f"CAST(ceil(m / {PART}) AS INT) AS m_parts")
    large = sizes.where("n_parts > 1 OR m_parts > 1")
    dealt = []
    for side, value, own, other in ((left, "a", "n", "m"), (right, "b", "m", "n")):
        placed = side.join(large, keys, "left").withColumn("own", F.expr(f"pmod(xxhash64({value}), coalesce({own}_parts, 1))"))
        spread = placed.withColumn("facing", F.expr(f"explode(sequence(0, coalesce({other}_parts, 1) - 1))"))
        names = ("own", "facing") if own == "n" else ("facing", "own")
        dealt.append(spread.select(*keys, value, *(F.col(c).cast("int").alias(f"part_{k}") for k, c in enumerate(names))))
    return dealt[0].join(dealt[1], [*keys, "part_0", "part_1"])


def segment_count(length: str, minimum: float) -> str:
    """One more than the edits that a string of this length may have to a similar one, as SQL text."""
    longest = f"floor({length} / {minimum}D + {SLACK}D)"
    return f"CAST(floor({1 - minimum}D * {longest} + {SLACK}D) AS INT) + 1"


def levenshtein_candidates(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """(a, b) that have a segment of ``a`` in common where it may stand; a pair may come several times.

    Every string a is cut by its length into one segment more than the edits it
    can be apart from any similar string. Edits spoil one segment each, so one is
    left whole in b, shifted by no more than the edits before and behind it allow.
    ``left`` and ``right`` have distinct strings a and b.
    """
    if not 0.5 < minimum <= 1:
        raise ValueError("the least similarity must be above 0.5 and at most 1")
    cut = left.selectExpr("a", "char_length(a) AS size", f"{segment_count('char_length(a)', minimum)} AS parts")
    cut = cut.selectExpr("a", "size", "parts", "explode(sequence(1, parts)) AS number")
    start, width = _segment("size", "parts", "number")
    cut = cut.selectExpr("a", "size", "number", f"substring(a, {start}, {width}) AS segment")

    sizes = f"sequence(CAST(ceil({minimum}D * own - {SLACK}D) AS INT), CAST(floor(own / {minimum}D + {SLACK}D) AS INT))"
    probe = right.selectExpr("b", "char_length(b) AS own").selectExpr("b", "own", f"explode({sizes}) AS size")
    probe = probe.selectExpr("b", "own", "size", "own - size AS longer", f"{segment_count('size', minimum)} AS parts")
    probe = probe.selectExpr("*", "explode(sequence(1, parts)) AS number")
    start, width = _segment("size", "parts", "number")
    # The shift is at most number - 1 seen from the front and parts - number seen from the back.
    first = "greatest(1, place - (number - 1), place + longer - (parts - number))"
    last = "least(own - width + 1, place + (number - 1), place + longer + (parts - number))"
    probe = probe.selectExpr("b", "own", "size", "longer", "parts", "number", f"{start} AS place", f"{width} AS width")
    probe = probe.selectExpr("b", "size", "number", "width", f"{first} AS first", f"{last} AS last").where("first <= last")
    probe = probe.selectExpr("b", "size", "number", "width", "explode(sequence(first, last)) AS at")
    probe = probe.selectExpr("b", "size", "number", "substring(b, at, width) AS segment").distinct()
    return _met(cut, probe, ["size", "number", "segment"]).select("a", "b")


def _segment(size: str, parts: str, number: str) -> tuple[str, str]:
    """Place and width of a segment; all are equally wide, the last ones by one wider."""
    base, wide = f"({size} div {parts})", f"({size} % {parts})"
    width = f"CAST({base} + IF({number} > {parts} - {wide}, 1, 0) AS INT)"
    return f"CAST(1 + ({number} - 1) * {base} + greatest(0, {number} - 1 - ({parts} - {wide})) AS INT)", width


def _signature(strings: DataFrame, value: str, ranks: DataFrame) -> DataFrame:
    """(value, size, tokens): the characters of a string, the rarest first and repeats numbered."""
    characters = strings.selectExpr(value, f"explode(split({value}, '')) AS c").where("c <> ''").groupBy(value, "c").agg(F.count(F.lit(1)).alias("k"))
    # As many rows as there are different characters.
    ranked = characters.join(F.broadcast(ranks), "c").groupBy(value).agg(F.sort_array(F.collect_list(F.struct("spread", "c", "k"))).alias("held"))
    tokens = "flatten(transform(held, h -> transform(sequence(CAST(h.k AS INT), 1, -1), i -> concat(h.c, i)))) AS tokens"
    return ranked.selectExpr(value, f"char_length({value}) AS size", tokens)


def common_characters(size: str, other: str, minimum: float) -> str:
    """The least number of common characters with which strings of these lengths reach a Jaro similarity."""
    return f"CAST(ceil(({3 * minimum - 1}D * {size} * {other}) / ({size} + {other}) - {SLACK}D) AS INT)"


def jaro_candidates(left: DataFrame, right: DataFrame, minimum: float) -> DataFrame:
    """(a, b, tokens of both) of strings that share rare characters; a pair may come several times.

    The Jaro similarity of two lengths bounds the characters they must have in
    common from below, say c of n. With all characters in one order, rare ones
    first, the first n - c + k of either then share k of them. These k together
    with both lengths are the key: three for short strings, fewer for long ones,
    which have more to choose from.
    """
    if not 2 / 3 < minimum <= 1:
        raise ValueError("the least similarity must be above two thirds and at most 1")
    both = left.selectExpr("a AS s").unionAll(right.selectExpr("b AS s"))
    ranks = both.selectExpr("explode(array_distinct(split(s, ''))) AS c").where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("spread"))
    signed = {value: written(_signature(side, value, ranks)) for side, value in ((left, "a"), (right, "b"))}
    keyed = []
    least = 3 * minimum - 2
    for value in "ab":
        sizes = f"sequence(CAST(ceil({least}D * size - {SLACK}D) AS INT), CAST(floor(size / {least}D + {SLACK}D) AS INT))"
        faced = signed[value].selectExpr("*", f"explode({sizes}) AS other").selectExpr("*", f"{common_characters('size', 'other', minimum)} AS need")
        faced = faced.where("need <= least(size, other)")
        cases = " ".join(f"WHEN greatest(size, other) <= {most} THEN least({k}, need)" for k, most in CHOSEN)
        faced = faced.selectExpr("*", f"CASE {cases} ELSE least(1, need) END AS k")
        head = faced.selectExpr("*", "slice(tokens, 1, size - need + k) AS head")
        one = "transform(head, x -> x)"
        two = "flatten(transform(head, (x, i) -> transform(slice(head, i + 2, size(head)), y -> concat(x, '\\t', y))))"
        three = (
            "flatten(transform(head, (x, i) -> flatten(transform(slice(head, i + 2, size(head)), "
            "(y, j) -> transform(slice(head, i + j + 3, size(head)), z -> concat(x, '\\t', y, '\\t', z))))))"
        )
        combined = head.selectExpr(value, "size AS own", "other", f"explode(CASE k WHEN 3 THEN {three} WHEN 2 THEN {two} ELSE {one} END) AS rare")
        a, b = ("own", "other") if value == "a" else ("other", "own")
        # Keys that differ and have one hash only make a candidate more.
        keyed.append(written(combined.selectExpr(value, f"{a} AS size_a", f"{b} AS size_b", "xxhash64(rare) AS rare")))
    pairs = _met(*keyed, ["size_a", "size_b", "rare"]).select("a", "b", "size_a", "size_b").distinct()
    return pairs.join(signed["a"].selectExpr("a", "tokens AS tokens_a"), "a").join(signed["b"].selectExpr("b", "tokens AS tokens_b"), "b")


def similarity_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, method: str = "Levenshtein", minimum: float = 0.8
) -> DataFrame:
    """(left_value, right_value, score) of all pairs of distinct strings that reach ``minimum``.

    Exact for both methods. Nulls match nothing; two empty strings are equal for
    Levenshtein and have similarity 0 for Jaro, as everywhere here. Only distinct
    strings travel, and join back to their rows by equality.
    """
    a, b = _distinct(left, left_on, "a"), _distinct(right, right_on, "b")
    if method == "Levenshtein":
        longest = "greatest(char_length(a), char_length(b))"
        edits = f"CAST(floor({1 - minimum}D * {longest} + {SLACK}D) AS INT)"
        near = levenshtein_candidates(a, b, minimum).where(f"levenshtein(a, b, {edits}) >= 0").distinct()
        scored = near.selectExpr("a", "b", f"{levenshtein('a', 'b')} AS score")
    elif method == "Jaro":
        near = jaro_candidates(a, b, minimum)
        shared = f"size(array_intersect(tokens_a, tokens_b)) >= {common_characters('size_a', 'size_b', minimum)}"
        scored = near.where(shared).selectExpr("a", "b", f"{jaro('a', 'b')} AS score")
    else:
        raise ValueError(f"no similarity join for method {method!r}; choose Levenshtein or Jaro")
    # Behind a generator the score is computed once and not again for the filter.
    kept = scored.selectExpr("inline(array(named_struct('left_value', a, 'right_value', b, 'score', score)))")
    return kept.where(f"score >= {minimum}D")
