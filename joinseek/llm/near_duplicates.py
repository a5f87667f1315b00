"""SimHash near-duplicates, paired through vantage-point trees.

Two fingerprints within ``max_bits`` agree up to ``max_bits // slices`` bits in
one of ``slices`` slices of the 64 bits. For every slice a vantage-point tree is
laid over the distances of that slice: a node sends a fingerprint to the near or
the far branch, and the triangle inequality tells which fingerprints of the near
branch may still have a partner in the far one. The leaves are the shards. Each
fingerprint is at home in one shard of a slice and a guest in those whose border
it is close to, so every pair meets where one of them is at home; there the full
distance is tested exactly. Where a slice no longer tells fingerprints apart,
as where very many share its value, its tree goes on with all 64 bits and the
wider border that belongs to them.

Equal fingerprints are one node from the start, and a shard reports a spanning
forest of its links and not the links, so large groups of copies stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.llm.components import components
from joinseek.llm.hot import joined_by_key
from joinseek.llm.text import kept_table
from joinseek.session import quoted

HASH_SEED = 42


@dataclass(frozen=True)
class SimHashParams:
    """``sample`` fingerprints at most lay out the trees; all are routed and compared.

    Trees are as deep as shards of ``shard`` home fingerprints ask for, and at
    most ``max_depth``, which bounds what every task is sent. A shard with more
    than ``split`` places is worked on in pairs of parts of about that size.
    """

    shingle: int = 4
    max_bits: int = 4
    slices: int = 3
    shard: int = 512
    sample: int = 8_192
    max_depth: int = 14
    split: int = 20_000


def fingerprint(data: bytes, width: int) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number."""
    tokens = data.lower().split()  # bytes: A-Z, and white space as in ASCII
    if not tokens:
        return 0
    if len(tokens) <= width:
        return xxhash.xxh64_intdigest(b" ".join(tokens), HASH_SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, params: SimHashParams, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, fp) of every row; fp is the fingerprint as a signed bigint, 0 without words."""
    width = params.shingle
    slim = docs.select(F.col(quoted(key)).cast("long").alias("doc"), F.col(quoted(text)).cast("binary").alias("body"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(body.as_py() or b"", width) for body in batch.column(1)]
            signed = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed)], names=["doc", "fp"])

    return slim.mapInArrow(hashed, "doc bigint, fp bigint")


@dataclass(frozen=True)
class Tree:
    """One slice's tree in heap order.

    Each inner node has a vantage point, a radius, the bits it compares and how
    many of those may differ between partners.
    """

    depth: int
    points: np.ndarray
    radii: np.ndarray
    masks: np.ndarray
    reaches: np.ndarray

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, at home) of every place a fingerprint goes to."""
        row = np.arange(len(fps))
        node = np.zeros(len(fps), np.int64)
        home = np.ones(len(fps), bool)
        for _ in range(self.depth):
            apart = np.bitwise_count((fps[row] ^ self.points[node]) & self.masks[node]).astype(np.int64)
            radius, reach = self.radii[node], self.reaches[node]
            near = np.where(home, apart <= radius, apart <= radius + reach)
            far = np.where(home, apart > radius, apart > radius - reach)
            # A home fingerprint of the near branch visits the far one across the border.
            visit = home & near & (apart > radius - reach)
            row, node, home = (
                np.concatenate([row[near], row[far], row[visit]]),
                np.concatenate([2 * node[near] + 1, 2 * node[far] + 2, 2 * node[visit] + 2]),
                np.concatenate([home[near], home[far], np.zeros(visit.sum(), bool)]),
            )
        return row, node, home


ALL_BITS = (1 << 64) - 1


def grow_tree(sample: np.ndarray, low: int, width: int, max_bits: int, reach: int, depth: int) -> Tree:
    """A tree over one slice: each node splits its part of the sample at the median distance.

    Partners differ in at most ``reach`` bits of the slice. A node whose part of the
    sample agrees in the slice compares all bits, of which ``max_bits`` may differ.
    """
    mask = ((1 << width) - 1) << low
    inner = 2**depth - 1
    points, radii = np.zeros(inner, np.uint64), np.full(inner, width // 2, np.int64)
    masks, reaches = np.full(inner, mask, np.uint64), np.full(inner, reach, np.int64)
    parts = {0: sample}
    for node in range(inner):
        mine = parts.pop(node, sample[:0])
        if not len(mine):
            continue
        if len(mine) > 1 and not ((mine ^ mine[0]) & np.uint64(mask)).any():
            masks[node], reaches[node] = ALL_BITS, max_bits
        # The candidate that tells the sample apart best, of a few.
        tried = mine[:: max(1, len(mine) // 4)][:4]
        spread = [np.bitwise_count((mine ^ c) & masks[node]).astype(np.int64) for c in tried]
        best = max(range(len(tried)), key=lambda i: spread[i].var())
        points[node], radii[node] = tried[best], int(np.median(spread[best]))
        near = spread[best] <= radii[node]
        if near.all() and len(set(spread[best].tolist())) > 1:
            radii[node] -= 1
            near = spread[best] <= radii[node]
        parts[2 * node + 1], parts[2 * node + 2] = mine[near], mine[~near]
    return Tree(depth, points, radii, masks, reaches)


def _forest(
    fps: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], max_bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, its root) that join what is linked between two sides, by position."""
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for homes, others in sides:
        most = max(1, 4_000_000 // max(1, len(others)))
        at, rows = 0, min(16, most)
        while at < len(homes):
            mine = homes[at : at + rows]
            a, b = np.nonzero(np.bitwise_count(fps[mine, None] ^ fps[None, others]) <= max_bits)
            # Only links between what was still apart: blocks grow, so a dense group is one tree soon.
            x, y = parent[mine[a]], parent[others[b]]
            for code in np.unique(x[x != y] * len(fps) + y[x != y]).tolist():
                one, two = root(code // len(fps)), root(code % len(fps))
                parent[max(one, two)] = min(one, two)
            while (parent != parent[parent]).any():
                parent = parent[parent]
            at, rows = at + rows, min(2 * rows, most)
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[parent[linked]].view(np.int64)


def links(nodes: DataFrame, params: SimHashParams) -> DataFrame:
    """(u, v): links that connect exactly the fingerprints within ``max_bits``.

    ``nodes`` has each fingerprint once, as ``fp``.
    """
    total = nodes.count()
    depth = min(params.max_depth, max(0, ceil(log2(max(1, total) / params.shard))))
    drawn = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(params.sample)
    sample = drawn.toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    edges = [64 * k // params.slices for k in range(params.slices + 1)]
    reach = params.max_bits // params.slices
    trees = [grow_tree(sample, a, b - a, params.max_bits, reach, depth) for a, b in zip(edges, edges[1:], strict=False)]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                for number, tree in enumerate(trees):
                    row, shard, home = tree.route(fps.view(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard * len(trees) + number), pa.array(home), pa.array(fps[row])],
                        names=["shard", "home", "fp"],
                    )

    places = kept_table(nodes.select("fp").mapInArrow(routed, "shard bigint, home boolean, fp bigint"), "places")
    parts = f"CAST(ceil(count / {params.split}) AS INT)"
    large = places.groupBy("shard").count().where(f"count > {params.split}").selectExpr("shard", f"{parts} AS parts")
    # At most one row per leaf of the trees, whatever the corpus.
    dealt = places.join(F.broadcast(kept_table(large, "large")), "shard", "left").selectExpr(
        "shard", "home", "fp", "coalesce(parts, 1) AS parts", "CAST(pmod(xxhash64(fp), coalesce(parts, 1)) AS INT) AS own"
    )
    # Parts meet in pairs, so that a group holds two of them however large the shard is.
    dealt = dealt.selectExpr("shard", "home", "fp", "own", "explode(sequence(0, parts - 1)) AS met")
    dealt = dealt.selectExpr("shard", "least(own, met) AS one", "greatest(own, met) AS two", "home", "fp", "own = least(own, met) AS first")
    max_bits = params.max_bits

    def paired(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        home, first = rows["home"].to_numpy(dtype=bool), rows["first"].to_numpy(dtype=bool)
        if key[1] == key[2]:
            sides = [(np.flatnonzero(home), np.arange(len(fps)))]
        else:
            sides = [(np.flatnonzero(home & first), np.flatnonzero(~first)), (np.flatnonzero(home & ~first), np.flatnonzero(~home & first))]
        u, v = _forest(fps, sides, max_bits)
        return pd.DataFrame({"u": u, "v": v})

    return dealt.groupBy("shard", "one", "two").applyInPandas(paired, "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame, params: SimHashParams | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, the fingerprint as hexadecimal text.

    The component is the smallest key that can be reached over links of at most
    ``max_bits`` differing bits. Null and blank texts have fingerprint 0 and are
    linked like any other; a text of fewer words than a shingle is one shingle;
    equal rows stay and share their component; null keys never name one. A text of
    any length is read whole. An empty table gives no rows.
    """
    params = params or SimHashParams()
    marked = kept_table(fingerprints(docs, params, text, key), "fingerprints")
    nodes = kept_table(marked.groupBy("fp").agg(F.min("doc").alias("first")), "nodes")
    groups = kept_table(components(links(nodes, params)), "groups")
    rooted = nodes.join(groups, nodes["fp"] == groups["node"], "left").selectExpr("fp", "first", "coalesce(root, fp) AS root")
    rooted = kept_table(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("held"))
    found = joined_by_key(rooted, kept_table(least, "least"), ["root"], "held", rooted.count())
    named = kept_table(found.select("fp", "component"), "named")
    return marked.join(named, "fp").selectExpr(
        f"doc AS {quoted(key)}", "lower(lpad(hex(fp), 16, '0')) AS fingerprint", "component AS component_id"
    )


def one_of_each(docs: DataFrame, params: SimHashParams | None = None) -> DataFrame:
    """``docs`` with the smallest ``doc_id`` of every component; all columns stay.

    Rows that repeat a ``doc_id`` count as one document, of which one row stays;
    rows without a ``doc_id`` stay unless their group has a row with one.
    """
    found = near_duplicates(docs, params)
    lost = kept_table(found.where("component_id <> doc_id").selectExpr("doc_id AS __doc").distinct(), "copies")
    left = docs.join(lost, docs["doc_id"] == lost["__doc"], "left_anti")
    ids = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids.n == ids.d:
        return left
    named = left.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionAll(left.where("doc_id IS NULL"))
