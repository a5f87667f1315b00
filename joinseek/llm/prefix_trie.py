"""The prefix trie of conversations, and subtree totals by tree contraction.

Every conversation is a path from the root, one node per turn; conversations that
begin alike share nodes. The totals of all subtrees are found without walking the
tree level by level: rounds of joins alternately rake the leaves into their
parents and splice nodes out of unary chains, which about halves the chains; then
the spliced nodes are put back in reverse order, each with the total of what was
below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinseek.llm.hot import joined_by_key
from joinseek.llm.text import kept_table
from joinseek.session import quoted

NODE = ["c", "d"]
#: Code points of ids that are joined into one row on the way to their digest.
PIECE = 1 << 14
NO_ENDS = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, group: str, order: Sequence[str], xors: Sequence[str]) -> DataFrame:
    """``df`` with ``rank`` 0, 1, 2 ... in each group and, instead of ``xors``, what they xor to up to the row.

    ``group`` and ``xors`` are bigint columns without nulls; a missing value comes
    first in the order. Rows are sorted over all tasks, so a group of any size is
    dealt over many of them. What a group has in earlier tasks is then added from
    a table of less than two rows per task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, xors = df.columns, list(xors)
    at, places = names.index(group), [names.index(x) for x in xors]
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen, carried = None, 0, [0] * len(xors)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(at).to_numpy()
            new = np.r_[True, groups[1:] != groups[:-1]]
            starts = np.flatnonzero(new)
            own = np.cumsum(new) - 1
            rank = np.arange(len(groups)) - starts[own]
            head = own == 0 if last == groups[0] else np.zeros(len(groups), bool)
            rank[head] += seen
            columns = list(batch.columns)
            for k, place in enumerate(places):
                total = np.bitwise_xor.accumulate(batch.column(place).to_numpy())
                here = total ^ np.r_[0, total][starts][own]
                here[head] ^= carried[k]
                carried[k] = int(here[-1])
                columns[place] = pa.array(here)
            last, seen = groups[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rank, pa.int64()), pa.array(np.full(len(groups), part, np.int32))], names=[*names, "rank", "part"]
            )

    keys = [group, *order]
    ordered = df.repartitionByRange(parts, *(F.col(quoted(k)) for k in keys)).sortWithinPartitions(*(F.col(quoted(k)) for k in keys))
    scanned = kept_table(ordered.mapInArrow(scan, f"{schema}, rank bigint, part int"), "scanned")
    # A group that goes on in the next task: at most one per border.
    ends = scanned.groupBy(group, "part").agg(F.max(F.struct("rank", *xors)).alias("end"))
    ends = ends.selectExpr(group, "part", "end.*", f"count(1) OVER (PARTITION BY {quoted(group)}) AS tasks").where("tasks > 1")
    before = f"OVER (PARTITION BY {quoted(group)} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    earlier = ends.selectExpr(
        group, "part", f"sum(rank + 1) {before} AS n_before", *(f"bit_xor({x}) {before} AS {x}_before" for x in xors)
    ).where("n_before IS NOT NULL")
    seamed = scanned.join(F.broadcast(earlier), [group, "part"], "left")
    exact = {x: f"{x} ^ coalesce({x}_before, 0L) AS {x}" for x in xors}
    return seamed.selectExpr(*(exact.get(c, quoted(c)) for c in names), "rank + coalesce(n_before, 0L) AS rank")


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, a, b, chars) per turn: a digest of role and text in 128 bits, and the length of the text."""
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")}
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.xxhash64(empty["role"], empty["text"]).alias("a"),
        F.xxhash64(empty["text"], F.lit(1), empty["role"]).alias("b"),
        F.char_length(empty["text"]).cast("long").alias("chars"),
    )


def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """The conversations of every block with a beginning shared with the first one of the block.

    Conversation c gets the first h turns of conversation c - c % ``block`` and
    keeps its own after its first h, with h the crc32 of its decimal id modulo
    ``heads``. Returns (conv, place, a, b, chars, size) per turn, places from 0,
    and (conv, size) per conversation, those without a turn included.
    """
    ranked = kept_table(running(_turns(conversations), "conv", ["turn", "a", "b"], []), "ranked")
    sizes = ranked.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    planned = sizes.selectExpr("conv", "n", f"CAST(crc32(CAST(conv AS STRING)) % {heads} AS BIGINT) AS h", f"conv - conv % {block} AS base")
    bases = sizes.selectExpr("conv AS base", "n AS base_n")
    planned = planned.join(bases, "base", "left").selectExpr("conv", "n", "h", "base", "least(h, coalesce(base_n, 0L)) AS given")
    planned = kept_table(planned.selectExpr("*", "given + greatest(n - h, 0L) AS size"), "planned")
    first = ranked.where(f"conv % {block} = 0 AND rank < {heads - 1}").selectExpr("conv AS base", "rank AS place", "a", "b", "chars")
    # At most heads - 1 turns of a base meet the ids of its block.
    begun = planned.select("conv", "base", "h", "size").join(first, "base").where("place < h")
    columns = ["conv", "place", "a", "b", "chars", "size"]
    own = joined_by_key(ranked, planned, ["conv"], "n", ranked.count()).where("rank >= h")
    own = own.selectExpr("conv", "rank - h + given AS place", "a", "b", "chars", "size")
    return begun.select(*columns).unionAll(own.select(*columns)), planned.select("conv", "size")


def nodes_of(turns: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the node at which every conversation of a shared end ends.

    Nodes are (c, d, pc, n_convs, n_children, chars, n_ends, first_end): the
    smallest conversation through the node and its depth, that of its parent (null
    for the root), and what belongs to the node itself. The second table has
    (c, d, member) for nodes at which several conversations end.

    A prefix is known by its depth and the xor of one 128-bit digest per turn and
    place, which a running xor gives for all prefixes at once.
    """
    placed = turns.selectExpr(
        "conv", "place", "xxhash64(place, a, b) AS x", "xxhash64(b, a, place) AS y", "chars", "size",
        "xxhash64(place, a, b) AS own_x", "xxhash64(b, a, place) AS own_y",
    )
    prefixes = running(placed, "conv", ["place"], ["x", "y"])
    below = prefixes.selectExpr("conv", "place + 1 AS d", "x", "y", "x ^ own_x AS px", "y ^ own_y AS py", "chars", "place + 1 = size AS ends")
    top = sizes.selectExpr("conv", "0L AS d", "0L AS x", "0L AS y", "NULL AS px", "NULL AS py", "0L AS chars", "size = 0 AS ends")
    paths = kept_table(below.unionAll(top), "paths")
    nodes = paths.groupBy("d", "x", "y").agg(
        F.min("conv").alias("c"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("chars").alias("chars"),
        F.max("px").alias("px"),
        F.max("py").alias("py"),
        F.count_if("ends").alias("n_ends"),
        F.min(F.expr("IF(ends, conv, NULL)")).alias("first_end"),
    )
    nodes = kept_table(nodes, "nodes")
    children = nodes.where("d > 0").groupBy(F.expr("d - 1 AS d"), F.expr("px AS x"), F.expr("py AS y")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = kept_table(nodes.join(children, ["d", "x", "y"], "left").na.fill(0, ["n_children"]), "counted")
    parents = counted.where("n_children > 0").selectExpr("d + 1 AS d", "x AS px", "y AS py", "c AS pc", "n_children AS weight")
    parented = joined_by_key(counted.where("d > 0"), parents, ["d", "px", "py"], "weight", counted.count())
    columns = ["c", "d", "pc", "n_convs", "n_children", "chars", "n_ends", "first_end"]
    root = counted.where("d = 0").selectExpr("c", "d", "CAST(NULL AS BIGINT) AS pc", *columns[3:])
    named = kept_table(parented.select(*columns).unionAll(root), "named")
    shared = counted.where("n_ends > 1").select("d", "x", "y", "c", "n_ends")
    ended = joined_by_key(paths.where("ends").select("d", "x", "y", "conv"), shared, ["d", "x", "y"], "n_ends", paths.count())
    return named, ended.selectExpr("c", "d", "conv AS member")


def ids_digests(members: DataFrame) -> DataFrame:
    """(c, d, ends_sha256) of the ascending, comma-joined members of each node.

    Ids are sorted over all tasks and joined into pieces there; the pieces of a
    node are then hashed as they pass by, so no list of ids is held as a whole.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            arrays = [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*NODE, "first", "piece"])

        for batch in batches:
            for c, d, member in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (c, d) != node or size >= PIECE:
                    if held:
                        out.append((*node, first, ",".join(held)))
                    node, first, held, size = (c, d), member, [], 0
                held.append(str(member))
                size += len(held[-1]) + 1
            if out:
                yield batch_of()
        if held:
            out.append((*node, first, ",".join(held)))
            yield batch_of()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for c, d, _, piece in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if (c, d) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (c, d), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            if done:
                yield _digest_batch(done)
        if node is not None:
            yield _digest_batch([(*node, digest.hexdigest())])

    keys = [*NODE, "member"]
    ordered = members.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    joined = ordered.mapInArrow(pieces, "c bigint, d bigint, first bigint, piece string")
    dealt = joined.repartition(parts, *NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(hashed, "c bigint, d bigint, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    c, d, digests = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(digests, pa.string())], names=[*NODE, "ends_sha256"])


def _on(left: DataFrame, right: DataFrame, names: dict[str, str]) -> DataFrame:
    """``left`` with the row of ``right`` whose columns equal its own, if there is one."""
    renamed = right.withColumnsRenamed({r: f"__{r}" for r in names.values()})
    condition = [F.col(a) == F.col(f"__{b}") for a, b in names.items()]
    return left.join(renamed, condition, "left").drop(*(f"__{b}" for b in names.values()))


def _sums(values: Sequence[str], named: str = "") -> list:
    return [F.sum(v).alias(f"{named}{v}") for v in values]


def _rake(live: DataFrame, values: Sequence[str], number: int) -> tuple[DataFrame, DataFrame]:
    """The leaves, whose values are their totals, and the other nodes with those of their leaves added."""
    parents = live.where("pc IS NOT NULL").select("pc", "pd").distinct().withColumn("inner", F.lit(True))
    flagged = kept_table(_on(live, parents, {"c": "pc", "d": "pd"}), f"raked-{number}")
    leaves = flagged.where("inner IS NULL").drop("inner")
    gains = leaves.where("pc IS NOT NULL").groupBy("pc", "pd").agg(*_sums(values, "gain_"))
    rest = _on(flagged.where("inner").drop("inner"), gains, {"c": "pc", "d": "pd"})
    return leaves, rest.selectExpr("c", "d", "pc", "pd", *(f"{v} + coalesce(gain_{v}, 0L) AS {v}" for v in values))


def _compress(live: DataFrame, values: Sequence[str], number: int) -> tuple[DataFrame, DataFrame]:
    """The nodes spliced out of unary chains, with their child (cc, cd), and the others.

    A node with one child goes if it comes before its neighbours in the order of
    how often two divides the depth: of a chain just read, every other node. So no
    two neighbours go, and their rounds are as many as the depth has digits.
    """
    kids = live.where("pc IS NOT NULL").groupBy("pc", "pd").agg(F.count(F.lit(1)).alias("kids"), F.min("c").alias("cc"), F.min("d").alias("cd"))
    flagged = _on(live, kids.where("kids = 1").drop("kids"), {"c": "pc", "d": "pd"})
    above = flagged.where("cc IS NOT NULL").selectExpr("cc AS oc", "cd AS od", "true AS chained")
    flagged = _on(flagged, above, {"c": "oc", "d": "od"})

    def order(depth: str) -> str:
        return f"struct({depth} & -{depth}, xxhash64({depth}))"

    goes = f"pc IS NOT NULL AND cc IS NOT NULL AND (chained IS NULL OR {order('d')} < {order('pd')}) AND {order('d')} < {order('cd')}"
    flagged = kept_table(flagged.selectExpr("c", "d", "pc", "pd", *values, "cc", "cd", f"coalesce({goes}, false) AS goes"), f"compressed-{number}")
    spliced = flagged.where("goes").drop("goes")
    rest = flagged.where("NOT goes").select("c", "d", "pc", "pd", *values)
    rest = _on(rest, spliced.selectExpr("cc AS oc", "cd AS od", "pc AS new_pc", "pd AS new_pd"), {"c": "oc", "d": "od"})
    gains = spliced.groupBy("pc", "pd").agg(*_sums(values, "gain_")).withColumnsRenamed({"pc": "oc", "pd": "od"})
    rest = _on(rest, gains, {"c": "oc", "d": "od"})
    return spliced, rest.selectExpr(
        "c", "d", "coalesce(new_pc, pc) AS pc", "coalesce(new_pd, pd) AS pd", *(f"{v} + coalesce(gain_{v}, 0L) AS {v}" for v in values)
    )


def subtree_totals(nodes: DataFrame, values: Sequence[str]) -> DataFrame:
    """(c, d, values): sums of bigint columns over the subtree of every node, its top included.

    ``nodes`` has (c, d, pc, pd, values); the roots have no parent, and depths
    grow downwards. Nodes are keys of joins and are only counted or added per
    parent, so a node may have any number of children, and a chain any length.
    """
    values = list(values)
    live, known, spliced_in = nodes.select("c", "d", "pc", "pd", *values), [], []
    number = 0
    while True:
        number += 1
        leaves, live = _rake(live, values, number)
        known.append(leaves.select("c", "d", *values))
        spliced, live = _compress(live, values, number)
        spliced_in.append((len(known), spliced))
        if live.isEmpty():
            break
    found: list[DataFrame] = []
    # A child was still there when its parent went: it is among the leaves of later rounds or was spliced later.
    for before, spliced in reversed(spliced_in):
        totals = None
        for part in [*known[before:], *found]:
            totals = part if totals is None else totals.unionAll(part)
        if totals is None:
            continue
        below = totals.selectExpr("c AS oc", "d AS od", *(f"{v} AS below_{v}" for v in values))
        put_back = spliced.join(below, (F.col("cc") == F.col("oc")) & (F.col("cd") == F.col("od")))
        found.append(kept_table(put_back.selectExpr("c", "d", *(f"{v} + below_{v} AS {v}" for v in values)), "expanded"))
    totals = known[0]
    for part in [*known[1:], *found]:
        totals = totals.unionAll(part)
    return totals


def prefix_trie(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """A row per node of the trie of the rebuilt conversations (see ``rebuilt``).

    Result: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), all bigint but the last. ``saved_tokens`` counts
    the code points that a shared turn saves, summed over the subtree.

    Turns are taken in the order of ``turn``, missing ones first, those of equal
    turn by a digest of role and text; equal rows are turns of their own. A null
    role or text is empty; rows without a conv_id belong to no conversation. A
    long text is read once, for its digest. An empty table has no root. Columns
    other than conv_id, turn, role and text are not read.
    """
    turns, sizes = rebuilt(conversations, block, heads)
    nodes, members = nodes_of(turns, sizes)
    own = nodes.selectExpr(
        "c", "d", "pc", "IF(pc IS NULL, NULL, d - 1) AS pd", "IF(n_children = 0, 1L, 0L) AS n_leaves", "(n_convs - 1) * chars AS saved_tokens"
    )
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"])
    full = _on(_on(nodes, totals, {"c": "c", "d": "d"}), ids_digests(members), {"c": "c", "d": "d"})
    one = f"CASE n_ends WHEN 0 THEN '{NO_ENDS}' WHEN 1 THEN sha2(CAST(first_end AS STRING), 256) ELSE ends_sha256 END AS ends_sha256"
    return full.selectExpr(
        "c AS conv_id", "d AS depth", "pc AS parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", one
    )
