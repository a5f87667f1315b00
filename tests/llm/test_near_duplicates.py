import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from joinseek.llm.components import components
from joinseek.llm.near_duplicates import SimHashParams, fingerprint, grow_tree, links, near_duplicates, one_of_each

DRAW = random.Random(11)


def plain_fingerprint(text, width=4):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    found = [w for w in lowered.split(" ") if w]
    grams = [found[i : i + width] for i in range(max(1, len(found) - width + 1))] if found else []
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps, max_bits=4):
    """Smallest position reachable over links, by repeated minima."""
    values = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= max_bits
    label = np.arange(len(values))
    while True:
        least = np.where(near, label[None, :], len(values)).min(axis=1)
        if (least == label).all():
            return label.tolist()
        label = least


@pytest.mark.parametrize("text", [None, "", " \n", "A b", "a B c d", "É é Ä  x\ty z\x85q", "the " * 7, "w " * 70000 + "tail words end here"])
def test_fingerprint(text):
    assert fingerprint((text or "").encode(), 4) == plain_fingerprint(text)


def clustered(n):
    """Random fingerprints, chains of near ones, and a dense ball."""
    out = [DRAW.getrandbits(64) for _ in range(n)]
    for start in out[:20]:
        now = start
        for _ in range(8):
            for bit in DRAW.sample(range(64), 4):
                now ^= 1 << bit
            out.append(now)
    for _ in range(150):
        out.append(out[0] ^ (1 << DRAW.randrange(64)) ^ (1 << DRAW.randrange(64)))
    return sorted(set(out))


@pytest.mark.parametrize("params", [SimHashParams(), SimHashParams(shard=8, sample=50, split=5), SimHashParams(max_depth=1, split=60), SimHashParams(slices=2, shard=30), SimHashParams(slices=5, shard=30, sample=0)])
def test_links_connect_what_brute_force_connects(spark, params):
    fps = clustered(400)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    found = links(nodes, params)
    assert found.count() <= 40 * len(fps)
    root = {r.node: r.root for r in components(found).collect()}
    got = [root.get(x, x) for x in signed]
    want = grouped(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_every_pair_meets_where_one_is_at_home():
    fps = np.array(clustered(300), dtype=np.uint64)
    tree = grow_tree(fps[:64], 0, 64, 4, 4, 5)
    row, shard, home = tree.route(fps)
    assert home.sum() == len(fps)
    at = {(int(s), int(r)) for r, s in zip(row, shard, strict=True)}
    own = {int(r): int(s) for r, s, h in zip(row, shard, home, strict=True) if h}
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert all((own[a], b) in at or (own[b], a) in at for a, b in near.tolist())


def test_equal_slices_are_told_apart_by_all_bits(spark):
    """A third and more of the fingerprints share the low slice."""
    fps = sorted({x & ~((1 << 21) - 1) for x in clustered(400)} | set(clustered(100)))
    values = np.array(fps, dtype=np.uint64)
    tree = grow_tree(values[::2], 0, 21, 4, 1, 6)
    assert (tree.reaches == 4).any() and (tree.reaches == 1).any()
    row, shard, home = tree.route(values)
    assert np.bincount(shard[home]).max() < len(fps) / 4
    own = {int(r): int(s) for r, s, h in zip(row, shard, home, strict=True) if h}
    at = {(int(s), int(r)) for r, s in zip(row, shard, strict=True)}
    apart = values[:, None] ^ values[None, :]
    close = np.argwhere((np.bitwise_count(apart) <= 4) & (np.bitwise_count(apart & np.uint64((1 << 21) - 1)) <= 1))
    assert all((own[a], b) in at or (own[b], a) in at for a, b in close.tolist())
    nodes = spark.createDataFrame([(x,) for x in values.view(np.int64).tolist()], "fp bigint")
    root = {r.node: r.root for r in components(links(nodes, SimHashParams(shard=16, split=40))).collect()}
    got, want = [root.get(x, x) for x in values.view(np.int64).tolist()], grouped(fps)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (700, 600)]
    DRAW.shuffle(chain)
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 400), 100), 600: 600, 700: 600}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_documents(spark):
    base = " ".join(f"w{DRAW.randint(0, 500)}" for _ in range(400))
    rows = [(9, base), (3, base.upper().replace("W", "w")), (5, base + " tail"), (1, None), (2, ""), (4, " "), (7, "x"), (7, "x"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit(1)).withColumn("root", F.lit(2))
    got = near_duplicates(docs).collect()
    assert all(r.fingerprint == f"{plain_fingerprint(dict((i, t) for i, t in rows)[r.doc_id]):016x}" for r in got)
    assert {(r.doc_id, r.component_id) for r in got} == {(9, 3), (3, 3), (5, 3), (1, 1), (2, 1), (4, 1), (7, 7), (None, 3)}
    assert len(got) == len(rows)
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == [1, 3, 7]
    assert near_duplicates(docs.limit(0)).count() == 0
