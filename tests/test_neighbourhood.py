import random

import pytest
from pyspark.sql import functions as F

from joinseek.operators.neighbourhood import global_rank, sorted_neighbourhood


def frames(spark, seed, kind):
    rng = random.Random(seed)
    make = {"int": lambda: rng.randint(0, 60), "string": lambda: rng.choice("abcdefgh") + rng.choice("xyz"), "double": lambda: rng.randint(0, 60) / 2}[kind]
    rows = [[(None if rng.random() < 0.1 else make(), rng.choice([1, 2, None])) for _ in range(50)] for _ in "lr"]
    # One key value with many tuples.
    rows[0] += [(rows[0][0][0], i) for i in range(20)]
    return [spark.createDataFrame(r, f"{n} {kind}, b int") for r, n in zip(rows, ("k", "q"), strict=True)], rows


def brute(left, right, reach, blocked):
    cut = 2 if blocked else 1
    l = {t[:cut] for t in left if t[0] is not None}
    r = {t[:cut] for t in right if t[0] is not None}
    place = {v: i for i, v in enumerate(sorted({t[0] for t in l | r}))}
    return {(a, b) for a in l for b in r if abs(place[a[0]] - place[b[0]]) <= reach and a[1:] == b[1:]}


@pytest.mark.parametrize("kind", ["int", "string", "double"])
@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize("partitions", [1, 5])
def test_pairs_agree_with_brute_force(spark, kind, blocked, partitions):
    (l, r), (l_rows, r_rows) = frames(spark, 7, kind)
    on = (["k", "b"], ["q", "b"]) if blocked else (["k"], ["q"])
    found = sorted_neighbourhood(l, r, *on, window=5, partitions=partitions)

    def value(row, side):
        block = [] if not blocked else [None if row[f"{side}_1"] is None else int(row[f"{side}_1"])]
        return (row[f"{side}_0"], *block)

    rows = found.collect()
    pairs = [(value(x, "left"), value(x, "right")) for x in rows]
    expected = brute(l_rows, r_rows, 2, blocked)
    assert set(pairs) == expected and len(pairs) == len(expected)
    for (a, b), x in zip(pairs, rows, strict=True):
        assert x.exact == (a == b and None not in a)


def test_exact_pairs_are_the_distinct_equi_join(spark):
    (l, r), _ = frames(spark, 9, "int")
    found = sorted_neighbourhood(l, r, ["k", "b"], ["q", "b"]).where("exact").count()
    a, b = l.distinct().alias("a"), r.distinct().alias("b")
    assert found == a.join(b, (F.col("a.k") == F.col("b.q")) & (F.col("a.b") == F.col("b.b"))).count()


def test_window_must_be_odd(spark):
    with pytest.raises(ValueError):
        sorted_neighbourhood(spark.range(2), spark.range(2), ["id"], ["id"], window=4)


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_global_rank_for_any_partition_count(spark, partitions):
    keys = spark.range(500).selectExpr("(id * 7919) % 100003 AS key")
    found = {r.key: r["rank"] for r in global_rank(keys, "key", partitions).collect()}
    assert found == {k: i + 1 for i, k in enumerate(sorted(found))} and len(found) == 500
