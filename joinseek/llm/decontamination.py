"""Benchmark decontamination: fingerprints of item-sized windows, then exact similarity.

1. A window of a document can only be similar to an item if both share a
   shingle. Shared shingles fix where windows of the item's size begin; all other
   windows have similarity 0 and need no fingerprint.
2. Each such window gets a SimHash. Fingerprints are cut into six blocks; two of
   them within 17 bits agree in some block up to two bits, so items are indexed
   under every block value within two bits and windows look up their own values.
3. Pairs within the radius are verified: weighted Jaccard of their shingles, the
   weight of a shingle being how often it occurs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.llm.text import kept_table, words
from joinseek.session import quoted

BLOCKS = 6
FLIPS = 2
#: Pigeonhole: with more bits apart, every block could differ in three bits.
RADIUS = BLOCKS * (FLIPS + 1) - 1


@dataclass(frozen=True)
class DecontaminationParams:
    """``broadcast_rows`` is the largest lookup table sent to executors at once.

    A larger one is cut into that many more passes over the documents.
    """

    shingle: int = 5
    min_similarity: float = 0.8
    broadcast_rows: int = 1_000_000


def _digest(df: DataFrame, text: str):
    """128 bits of the whole text, which tell rows apart that share a key."""
    return F.unhex(F.md5(F.coalesce(df[quoted(text)], F.lit(""))))


def _lower_words(df: DataFrame, text: str):
    return words(F.lower(F.col(quoted(text))))


def _shingles(of: str, n: str) -> str:
    return f"transform(sequence(0, size({of}) - {n}), i -> array_join(slice({of}, i + 1, {n}), ' '))"


def _fingerprint(shingles: str) -> str:
    """64 bits, each 1 if it is set in over half the shingles' hashes."""
    hashes = f"transform({shingles}, s -> xxhash64(s))"
    set_in = "size(filter(h, x -> (shiftright(x, b) & 1L) = 1L))"
    bits = f"aggregate(sequence(0, 63), 0L, (f, b) -> f | IF(2 * {set_in} > size(h), shiftleft(1L, b), 0L))"
    # One element, so that the hashes are made once and not once for each bit.
    return f"transform(array({hashes}), h -> {bits})[0]"


def _blocks() -> list[tuple[int, int]]:
    """Lowest bit and width of each block."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:], strict=False)]


def _block_values(fingerprint: str, near: bool) -> str:
    """Array of (block, value), with all values within FLIPS bits if ``near``."""
    rows = []
    for number, (low, width) in enumerate(_blocks()):
        value = f"shiftrightunsigned({fingerprint}, {low}) & {(1 << width) - 1}L"
        if not near:
            rows.append(f"array(named_struct('block', {number}, 'value', {value}))")
            continue
        masks = [sum(1 << b for b in chosen) for n in range(FLIPS + 1) for chosen in combinations(range(width), n)]
        listed = ", ".join(f"{m}L" for m in masks)
        flipped = f"({value}) ^ m"
        rows.append(f"transform(array({listed}), m -> named_struct('block', {number}, 'value', {flipped}))")
    return f"concat({', '.join(rows)})"


def item_table(benchmark: DataFrame, params: DecontaminationParams, text: str, key: str) -> DataFrame:
    """(item, n, length, shingles, fingerprint) of items that have words.

    Items shorter than a shingle are one shingle of their own length.
    """
    items = benchmark.select(F.col(quoted(key)).alias("item"), _lower_words(benchmark, text).alias("w"))
    items = items.where("size(w) > 0").selectExpr("item", "size(w) AS length", f"least(size(w), {params.shingle}) AS n", "w")
    items = items.selectExpr("item", "length", "n", f"{_shingles('w', 'n')} AS shingles")
    return items.selectExpr("item", "length", "n", "shingles", f"{_fingerprint('shingles')} AS fingerprint")


def _windows(docs: DataFrame, items: DataFrame, params: DecontaminationParams, text: str, key: str) -> DataFrame:
    """(doc, body, start, length, n, window) of every window that shares a shingle with an item of its length."""
    anchors = items.selectExpr("length", "n", "posexplode(shingles) AS (at, shingle)")
    anchors = kept_table(anchors.selectExpr("n", "xxhash64(shingle) AS h", "at", "length").distinct(), "anchors")
    rows = anchors.count()
    sizes = [r.n for r in anchors.select("n").distinct().collect()]  # 1 to params.shingle
    if not sizes:
        sizes = [params.shingle]
    passes = max(1, ceil(rows / params.broadcast_rows))
    split = docs.select(F.col(quoted(key)).alias("doc"), _digest(docs, text).alias("body"), _lower_words(docs, text).alias("w"))
    places = split.selectExpr("doc", "body", "w", "posexplode(w) AS (p, first)")
    found = []
    for n in sizes:
        parts = "".join(f", ' ', get(w, p + {k})" for k in range(1, n))
        hashed = places.where(f"p + {n} <= size(w)").selectExpr("doc", "body", "w", "p", f"xxhash64(concat(first{parts})) AS h")
        for k in range(passes):
            # At most params.broadcast_rows rows of three numbers, by the count above.
            mine = F.broadcast(anchors.where(f"n = {n} AND pmod(h, {passes}) = {k}").select("h", "at", "length"))
            found.append(hashed.join(mine, "h").selectExpr("doc", "body", "w", "p - at AS start", "length", f"{n} AS n"))
    near = reduce(DataFrame.unionAll, found).selectExpr(
        "doc", "body", "start", "length", "n", "greatest(start - length, 0) AS low",
        "slice(w, greatest(start - length, 0) + 1, greatest(start, 0) + length - greatest(start - length, 0)) AS around",
    )
    near = near.groupBy("doc", "body", "start", "length", "n", "low").agg(F.first("around").alias("around"))
    # Words added to or missing from a passage move its shingles apart; the best
    # window may begin between two such starts.
    previous = "lag(start) OVER (PARTITION BY doc, body, length ORDER BY start)"
    filled = near.selectExpr("*", f"coalesce({previous}, start - length - 1) AS previous")
    filled = filled.selectExpr(
        "doc", "body", "length", "n", "low", "around",
        "explode(IF(start - previous <= length, sequence(least(previous + 1, start), start), array(start))) AS start",
    )
    return filled.selectExpr(
        "doc", "body", "greatest(start, 0) AS start", "length", "n",
        "slice(around, greatest(start, 0) - low + 1, length) AS window",
    ).where("size(window) >= n")


def _weighted_jaccard(left: str, right: str) -> str:
    """Shared over all occurrences of shingles.

    What both hold is counted once by an intersection; only second and later
    occurrences are compared one by one.
    """
    again = "transform(array(sort_array({})), s -> filter(s, (x, i) -> x = get(s, i + 1)))[0]"
    later = f"named_struct('l', {again.format(left)}, 'r', {again.format(right)})"
    least = "least(size(filter(e.l, y -> y = x)), size(filter(e.r, y -> y = x)))"
    more = f"aggregate(array_distinct(e.l), 0, (sum, x) -> sum + {least})"
    shared = f"transform(array({later}), e -> size(array_intersect({left}, {right})) + {more})[0]"
    return f"transform(array({shared}), s -> s / (size({left}) + size({right}) - s))[0]"


def _best(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams, text: str, key: str, item_key: str) -> DataFrame:
    """(doc, body, item, b) with the best window of every document and item in ``b``."""
    items = kept_table(item_table(benchmark, params, "text", item_key), "items")
    windows = _windows(docs, items, params, text, key)
    windows = windows.selectExpr("doc", "body", "start", "length", f"{_shingles('window', 'n')} AS shingles")
    windows = windows.selectExpr("doc", "body", "start", "length", "shingles", f"{_fingerprint('shingles')} AS fingerprint")
    windows = kept_table(windows, "windows")

    # Equal windows look up their fingerprint once, however many documents hold them.
    index = items.selectExpr("item", "length", "fingerprint", f"inline({_block_values('fingerprint', True)})")
    own = windows.select("length", F.col("fingerprint").alias("own")).distinct()
    looked_up = own.selectExpr("length", "own", f"inline({_block_values('own', False)})")
    pairs = looked_up.join(index, ["length", "block", "value"])
    pairs = pairs.selectExpr("length", "own", "item", "bit_count(own ^ fingerprint) AS hamming")
    pairs = kept_table(pairs.where(f"hamming <= {RADIUS}").distinct(), "pairs")

    near = F.expr("p.length = w.length AND p.own = w.fingerprint")
    texts = windows.alias("w").join(pairs.alias("p"), near).selectExpr("w.doc", "w.body", "w.start", "p.*", "w.shingles AS left_shingles")
    texts = texts.alias("t").join(items.alias("i"), F.expr("t.item <=> i.item AND t.length = i.length"))
    scored = texts.selectExpr("t.*", f"{_weighted_jaccard('left_shingles', 'i.shingles')} AS similarity")
    scored = scored.where(f"similarity >= {params.min_similarity}D")
    return scored.groupBy("doc", "body", "item").agg(
        F.max(F.expr("named_struct('s', similarity, 'n', -start, 'h', -hamming, 'l', length)")).alias("b")
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    params: DecontaminationParams | None = None,
    text: str = "text",
    key: str = "doc_id",
    item_key: str = "item_id",
) -> DataFrame:
    """The best window per document and item: (doc_id, item_id, start_word, n_words, hamming, similarity).

    Words are lower-cased runs of characters other than white space. Null and
    empty texts on either side match nothing. Rows that agree in key and text count
    as one document; rows that share a key, or have none, and differ in text are
    documents of their own, with a row each. Ties go to the earliest window. The key
    columns keep their names; no other column of the inputs is read.
    """
    best = _best(docs, benchmark, params or DecontaminationParams(), text, key, item_key)
    return best.selectExpr(
        f"doc AS {quoted(key)}", f"item AS {quoted(item_key)}", "-b.n AS start_word", "b.l AS n_words",
        "-b.h AS hamming", "round(b.s, 6) AS similarity",
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None) -> DataFrame:
    """``docs`` without those that hold a passage of the benchmark; all columns stay.

    Rows that share a key are judged each by its own text.
    """
    best = _best(docs, benchmark, params or DecontaminationParams(), "text", "doc_id", "item_id")
    dirty = kept_table(best.selectExpr("doc AS __doc", "body AS __body").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(dirty["__doc"]) & (_digest(docs, "text") == dirty["__body"])
    return docs.join(dirty, same, "left_anti")
