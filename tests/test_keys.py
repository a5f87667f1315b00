import random
import time
from itertools import combinations

import pytest

from joinseek.operators.keyrows import duplicate_witnesses
from joinseek.operators.keys import foreign_keys, slices_for, unique_keys
from joinseek.operators.profile import profile
from joinseek.operators.prune import pair_columns
from joinseek.plans.discover import pair_table
from joinseek.session import settle


def keys_of(tables, **options):
    found = unique_keys(tables, settle(profile(tables)), **options).collect()
    return {(r.table, tuple(c.name for c in r.columns)): r.percentage for r in found}


def brute_keys(rows, names, ratio, most):
    for size in range(1, most + 1):
        hits = {}
        for combo in combinations(range(len(names)), size):
            share = len({tuple(r[i] for i in combo) for r in rows}) / len(rows)
            if share >= ratio:
                hits[tuple(names[i] for i in combo)] = share
        if hits:
            return hits
    return {}


@pytest.mark.parametrize("seed", range(4))
def test_keys_agree_with_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d"]
    top = [3, 5, 8, 12][seed]
    rows = [tuple(None if rng.random() < 0.1 else rng.randint(0, top) for _ in names) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    found = keys_of({"t": df}, min_ratio=0.9)
    assert {k: v for (_, k), v in found.items()} == pytest.approx(brute_keys(rows, names, 0.9, 3))


def test_search_ends_at_the_first_size_with_a_hit_per_table(spark):
    line = spark.range(100).selectExpr("id", "id % 10 AS tens", "id div 10 AS ones")
    pair = line.drop("id")
    found = keys_of({"single": line, "double": pair, "none": pair.drop("ones")})
    assert found == {("single", ("id",)): 1.0, ("double", ("tens", "ones")): 1.0}


def test_missing_values_count_as_a_value(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert keys_of({"t": df}) == {("t", ("a",)): 1.0}
    df = spark.createDataFrame([(1,), (None,), (None,)], "a int")
    assert keys_of({"t": df}) == {}


def test_empty_table_has_no_key(spark):
    assert keys_of({"t": spark.createDataFrame([], "a int")}) == {}


def test_size_is_limited(spark):
    df = spark.range(16).selectExpr("id % 2 a", "id div 2 % 2 b", "id div 4 % 2 c", "id div 8 d")
    assert keys_of({"t": df}) == {}
    assert keys_of({"t": df}, max_columns=4) == {("t", ("a", "b", "c", "d")): 1.0}


@pytest.mark.parametrize("side", ["left", "right"])
def test_foreign_keys_assign_every_column_once(spark, side):
    keyed = spark.range(27).selectExpr("id % 3 x", "id div 3 % 3 y", "CAST(id div 9 AS STRING) z")
    other = spark.createDataFrame([(1, 2, 3, "a", True)], "p int, q int, r int, s string, t boolean")
    tables = {"keyed": keyed, "other": other}
    pair = ("keyed", "other") if side == "left" else ("other", "keyed")
    both = pair_columns(settle(profile(tables)), pair_table(spark, [pair]))
    scope = ["left_table", "right_table", "table"]
    keys = unique_keys(tables, both.where("table = 'keyed'"), scope=scope)
    same = [(c, c) for c in ("left_table", "right_table")]
    found = foreign_keys(keys, both.where("table = 'other'"), same, side).collect()
    own, chosen = ("left", "right") if side == "left" else ("right", "left")
    assert all(r[own] == ["x", "y", "z"] for r in found)
    expected = {(a, b, "s") for a in "pqr" for b in "pqr" if a != b}
    assert {tuple(r[chosen]) for r in found} == expected and len(found) == len(expected)


def test_a_wide_table_is_one_job_of_any_number_of_sets(spark):
    rng = random.Random(1)
    names = [f"c{i}" for i in range(40)]
    rows = [tuple(rng.randint(0, 11) for _ in names) for _ in range(1000)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    start = time.perf_counter()
    found = keys_of({"t": df}, min_ratio=0.95)
    assert time.perf_counter() - start < 120
    assert found == {}
    found = keys_of({"t": df}, min_ratio=0.74)
    assert {k: v for (_, k), v in found.items()} == pytest.approx(brute_keys(rows, names, 0.74, 3)) and found


def test_witnesses_are_true_duplicates_and_refute(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(40), rng.randrange(40), None if rng.random() < 0.2 else float(rng.randrange(5)), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c double, k int")
    sets = {("t", ("a", "b")): "a", ("t", ("a", "c")): "a", ("t", ("b", "k")): "k"}
    for slices in (1, 4, 64):
        found = {tuple(r.columns): r.duplicates for r in duplicate_witnesses(spark, {"t": df}, sets, slices).collect()}
        for (_, columns), _ in sets.items():
            places = ["abck".index(c) for c in columns]
            true = len(rows) - len({tuple(r[p] for p in places) for r in rows})
            assert found[columns] == true if slices == 1 else 0 <= found[columns] <= true
        assert found["b", "k"] == 0 and (slices == 64 or found["a", "b"] > 0)
    assert slices_for(1) == 64 and slices_for(0.95) == 10 and slices_for(0.1) == 2
