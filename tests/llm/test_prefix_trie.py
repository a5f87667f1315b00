"""The trie of conversations against one built by walking, and its parts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from joinseek.llm import hot, prefix_trie
from joinseek.llm.prefix_trie import running, subtree_totals

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def walked(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends, parent = defaultdict(list), defaultdict(list), {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        path = tuple(turns.get(conv - conv % 100, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                parent[path[:d]] = path[: d - 1]
        ends[path].append(conv)
    children = Counter(parent.values())
    leaves, saved = Counter(), Counter()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * (len(path[-1][1]) if path else 0)
        if path:
            leaves[parent[path]] += leaves[path]
            saved[parent[path]] += saved[path]
    rows = []
    for path, convs in members.items():
        ids = ",".join(map(str, sorted(ends[path])))
        above = min(members[parent[path]]) if path else None
        rows.append((min(convs), len(path), above, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(rows, key=repr)


def check(spark, rows):
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert [t for _, t in found.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == walked(rows)


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(hot, "HOT_SHARE", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rnd = random.Random(2)
    rows = []
    for conv in [*range(95, 140), 200, 203, 204, 350, 351, 352]:
        if conv == 100:
            continue
        for turn in range(rnd.randrange(1, 9)):
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "längerer Text"])))
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1060) for t in range(4)]
    rows += [(353, t, "user", f"long {t}") for t in range(18)]
    rnd.shuffle(rows)
    check(spark, rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "of no conversation"), (1, None, "user", "first"), (1, 0, None, None), (1, 2, "", ""), (1, 2, "", ""),
        (2, 0, "user", "x" * 300_000), (3, 0, "user", "x" * 300_000), (3, 7, None, "ü😀"), (107, None, None, None), (0, 5, "user", "only one"),
    ]
    check(spark, rows)


def test_empty_table_and_other_columns(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    names = ["conv", "place", "rank", "part", "c", "d", "a", "b", "x", "y", "size", "a.b"]
    wide = spark.createDataFrame([(1, 0, "user", "a", *names)], SCHEMA + "".join(f", `{n}` string" for n in names))
    _, sizes = prefix_trie.rebuilt(wide)
    assert [r.conv for r in sizes.collect()] == [1]


@pytest.mark.parametrize("parts", ["1", "5"])
def test_running_over_tasks(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rnd = random.Random(1)
        rows = [(rnd.choice([1, 2, 2, 2, 2, 3]), k, rnd.getrandbits(60)) for k in range(400)] + [(9, None, 5), (9, 1, 6)]
        found = running(spark.createDataFrame(rows, "g bigint, o bigint, x bigint"), "g", ["o"], ["x"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, seen = {}, defaultdict(lambda: (0, 0))
    for g, o, x in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        rank, total = seen[g]
        want[g, o] = (rank, total ^ x)
        seen[g] = (rank + 1, total ^ x)
    assert {(r.g, r.o): (r["rank"], r.x) for r in found} == want


def test_contraction_of_random_trees(spark):
    rnd = random.Random(7)
    depth, parent = {0: 0, 1: 0}, {}
    for k in range(2, 90):
        parent[k] = rnd.choice([k - 1, k - 1, k - 1, rnd.randrange(k)])
        depth[k] = depth[parent[k]] + rnd.choice([1, 1, 2])
    values = {k: rnd.randrange(100) for k in depth}
    rows = [(k, depth[k], parent.get(k), depth.get(parent.get(k)), values[k], 1) for k in depth]
    nodes = spark.createDataFrame(rows, "c bigint, d bigint, pc bigint, pd bigint, v bigint, n bigint")
    found = {r.c: (r.v, r.n) for r in subtree_totals(nodes, ["v", "n"]).collect()}
    totals = {k: [values[k], 1] for k in depth}
    for k in sorted(parent, reverse=True):
        totals[parent[k]] = [a + b for a, b in zip(totals[parent[k]], totals[k], strict=True)]
    assert found == {k: tuple(t) for k, t in totals.items()}
