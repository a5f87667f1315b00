import random
from collections import Counter
from decimal import Decimal
from itertools import combinations, permutations
from math import isnan

import pytest
from pyspark.sql import functions as F

from joinseek.operators import keyrows, levels


@pytest.fixture(scope="module")
def tables(spark):
    nan = float("nan")
    left = [(1, 1.0, "a", None), (1, 1.0, "a", None), (2, 2.5, None, "x" * 90), (None, nan, "b", "y"), (3, -0.0, "", "z")]
    right = [(1.0, 1, "a", None), (2.0, 2, None, "x" * 90), (None, None, "b", "y"), (3.0, 0, "", "z"), (3.0, 0, "", "w")]
    return {
        "one": spark.createDataFrame(left, "a bigint, `b c` double, d string, e string"),
        "two": spark.createDataFrame(right, "a double, `b c` int, d string, e string"),
        "empty": spark.createDataFrame([], "a bigint, `b c` double, d string, e string"),
    }


def brute(tables, row):
    def keys(name, columns):
        rows = tables[name].select(*(f"`{c}`" for c in columns)).collect()
        return {tuple(None if isinstance(v, float) and isnan(v) else v for v in r) for r in rows}

    left, right = keys(row.left_table, row.left), keys(row.right_table, row.right)
    both = left & right
    return len(left), len(right), len(both), sum(None not in k for k in both)


@pytest.mark.parametrize("masked", [0, 1000])
@pytest.mark.parametrize("other", ["two", "empty"])
def test_counts_equal_brute_force(spark, tables, monkeypatch, masked, other):
    monkeypatch.setattr(keyrows, "MASKED_SETS", masked)
    combos = [list(c) for k in (1, 2, 3) for c in combinations(["a", "b c", "d", "e"], k)]
    pairs = spark.createDataFrame([("one", other, c, c) for c in combos], "left_table string, right_table string, left array<string>, right array<string>")
    found = keyrows.pair_counts(tables, pairs).collect()
    assert len(found) == len(combos)
    for r in found:
        assert (r.n_left, r.n_right, r.common, r.full_common) == brute(tables, r), r


def test_pairs_that_share_a_set_use_masks(spark, tables, monkeypatch):
    monkeypatch.setattr(keyrows, "MASKED_SETS", 0)
    monkeypatch.setattr(keyrows, "_separate_counts", None)
    pairs = spark.createDataFrame([("one", "two", ["a"], ["a"]), ("one", "two", ["a"], ["b c"])], "left_table string, right_table string, left array<string>, right array<string>")
    found = keyrows.pair_counts(tables, pairs).where(F.size("left") == 1).collect()
    assert all((r.n_left, r.n_right, r.common, r.full_common) == brute(tables, r) for r in found)


@pytest.mark.parametrize("home_rows", [0, 10_000])
def test_few_wide_pairs_over_large_tables_make_no_masks(spark, tables, monkeypatch, home_rows):
    monkeypatch.setattr(keyrows, "MASKED_ROWS", 1, raising=False)
    monkeypatch.setattr(keyrows, "key_masks", None)
    monkeypatch.setattr(levels, "HOME_ROWS", home_rows)
    listed = [("one", "two", c, c) for c in (["a", "d"], ["d", "e"], ["a", "b c", "e"])] + [("one", "empty", ["d", "b c"], ["d", "b c"])]
    pairs = spark.createDataFrame(listed, "left_table string, right_table string, left array<string>, right array<string>")
    found = keyrows.pair_counts(tables, pairs).collect()
    assert len(found) == len(listed)
    assert all((r.n_left, r.n_right, r.common, r.full_common) == brute(tables, r) for r in found)


def test_plan_of_separate_pairs_has_no_wide_mask(spark, tables, monkeypatch):
    monkeypatch.setattr(keyrows, "MASKED_SETS", 0)
    pairs = spark.createDataFrame([("one", "two", [c], [c]) for c in "ade"], "left_table string, right_table string, left array<string>, right array<string>")
    plan = keyrows.pair_counts(tables, pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or(side" in plan and "w0" not in plan


def test_levels_leave_out_rows_alone_in_a_key(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 40), rng.choice([None, "a", "b"]), rng.randint(0, 2), rng.choice([None, 0.5, 2.0])) for i in range(120)]
    names = ["u", "v", "w", "x", "y"]
    tables = {
        "one": spark.createDataFrame(rows, "u int, v int, w string, x int, y double"),
        "two": spark.createDataFrame([(i + 100, *rest) for i, *rest in rows[:90]], "u int, v int, w string, x int, y double"),
    }
    combos = [list(c) for k in (2, 3) for c in combinations(names, k)]
    listed = [("one", "two", c, c) for c in combos] + [("one", "one", ["u", "v"], ["x", "u"]), ("two", "two", ["x"], ["v"])]
    pairs = spark.createDataFrame(listed, "left_table string, right_table string, left array<string>, right array<string>")
    pairs = pairs.where("left_table != right_table OR size(left) = 1")
    shuffled, plain = [], levels._keys

    def counted(*arguments):
        frame = plain(*arguments)
        shuffled.append(frame.count())
        return frame

    monkeypatch.setattr(levels, "_keys", counted)
    found = levels.level_counts(tables, pairs).collect()
    assert len(found) == len(combos) + 1
    for r in found:
        assert (r.n_left, r.n_right, r.common, r.full_common) == brute(tables, r), r
    # Keys are made of the rows that are alone in no smaller set, and of no others.
    sides = [[dict(zip(names, r, strict=True)) for r in tables[t].collect()] for t in ("one", "two")]
    both = sides[0] + sides[1]
    alone = {}
    for k in (1, 2):
        for c in combinations(names, k):
            often = Counter(tuple(r[n] for n in c) for r in both)
            alone[c] = [often[tuple(r[n] for n in c)] == 1 for r in both]
    expected = 0
    for k in (1, 2, 3):
        for c in combinations(names, k):
            inner = [alone[part] for size in range(1, k) for part in combinations(c, size)]
            expected += sum(not any(marks) for marks in zip(*inner, strict=True)) if inner else len(both)
    of_two = 2 * len(rows[:90])
    assert sum(shuffled) == expected + of_two
    assert expected < 25 * len(both)


def test_levels_of_one_table_on_both_sides(spark):
    rows = [(i % 7, i % 5, i % 3, i) for i in range(40)] + [(None, 1, None, 2)] * 3
    tables = {"t": spark.createDataFrame(rows, "a int, b int, c int, d int")}
    listed = [("t", "t", ["a", "b"], ["c", "d"]), ("t", "t", ["a"], ["b"]), ("t", "t", ["b", "a", "d"], ["d", "c", "a"])]
    pairs = spark.createDataFrame(listed, "left_table string, right_table string, left array<string>, right array<string>")
    found = levels.level_counts(tables, pairs).collect()
    assert len(found) == 3
    for r in found:
        assert (r.n_left, r.n_right, r.common, r.full_common) == brute(tables, r), r


PAIRS = "left_table string, right_table string, left array<string>, right array<string>"


@pytest.mark.parametrize("other", ["two", "empty"])
@pytest.mark.parametrize("told", [False, True])
def test_wide_pairs_over_large_tables_that_share_sets(spark, tables, monkeypatch, other, told):
    monkeypatch.setattr(keyrows, "MASKED_ROWS", 1)
    orders = [list(p) for k in (1, 2, 3) for p in permutations(["a", "b c"], k)] + [list(p) for p in permutations(["d", "e"], 2)]
    listed = [("one", other, x, y) for x in orders for y in orders if len(x) == len(y) and ("d" in x) == ("d" in y)]
    listed += [("one", other, ["a", "d", "e"], ["b c", *y]) for y in (["d", "e"], ["e", "d"])]
    pairs = spark.createDataFrame(listed, PAIRS)
    known = [("one", ["b c", "a"], brute(tables, pairs.where("size(left) = 2 AND left[0] = 'a'").first())[0])]
    known = spark.createDataFrame(known, "table string, columns array<string>, keys bigint") if told else None
    found = keyrows.pair_counts(tables, pairs, known).collect()
    assert len(found) == len(listed)
    for r in found:
        assert (r.n_left, r.n_right, r.common, r.full_common) == brute(tables, r), r


def test_wide_pairs_of_many_types_that_share_sets(spark, monkeypatch):
    monkeypatch.setattr(keyrows, "MASKED_ROWS", 1)
    rng = random.Random(3)
    names = ["i", "x", "m", "big", "t", "b"]

    def row(low):
        number = rng.choice([None, low + rng.randint(-3, 3), low + rng.randint(-3, 3), low + 0.5])
        whole = None if number is None else int(number)
        exact = None if number is None else Decimal(str(number))
        word = rng.choice([None, "", "'\\", "\u00e9" * 40, "word" if low else "Word"])
        return (whole, rng.choice([None if number is None else float(number), float("inf"), -0.0, float("nan")]), exact, whole, word, rng.choice([None, True, low > 0]))

    schema = "i int, x double, m decimal(12, 2), big decimal(30, 0), t string, b boolean"
    rows = {"one": [row(0) for _ in range(60)], "two": [row(3) for _ in range(40)]}
    tables = {t: spark.createDataFrame([(*r[:3], None if r[3] is None else Decimal(r[3]), *r[4:]) for r in rs], schema) for t, rs in rows.items()}
    numbers = [list(p) for p in permutations(names[:4], 2)]
    listed = [("one", "two", x, y) for x in numbers for y in numbers]
    listed += [("one", "two", [x, "t", "b"], [y, "t", "b"]) for x in names[:4] for y in names[:4]]
    found = keyrows.pair_counts(tables, spark.createDataFrame(listed, PAIRS)).collect()

    def plain(value):
        if value is None or (isinstance(value, float) and isnan(value)):
            return None
        return value if isinstance(value, str | bool) else float(value)

    keys = {
        (t, c): {tuple(plain(r[names.index(n)]) for n in c) for r in rs}
        for t, rs in rows.items()
        for c in {tuple(p[k]) for p in listed for k in (2, 3)}
    }
    assert len(found) == len(listed)
    for r in found:
        left, right = keys["one", tuple(r.left)], keys["two", tuple(r.right)]
        both = left & right
        assert (r.n_left, r.n_right, r.common, r.full_common) == (len(left), len(right), len(both), sum(None not in k for k in both)), r


def test_rows_that_cannot_match_make_no_keys(spark, monkeypatch):
    """Nor are the keys of sets counted that are known, hold a unique column, or differ in the order of columns."""
    monkeypatch.setattr(keyrows, "MASKED_ROWS", 1)
    tables = {
        "big": spark.range(2000).selectExpr("id AS k", "900 + id / 100 AS price"),
        "small": spark.range(50).selectExpr("id AS e", "id % 7 AS u", "id / 4 AS v"),
    }
    rights = [list(p) for p in permutations(["e", "u", "v"], 2)]
    pairs = spark.createDataFrame([("big", "small", ["k", "price"], r) for r in rights], PAIRS)
    known = spark.createDataFrame([("big", ["k", "price"], 2000), ("small", ["e"], 50), ("small", ["u"], 7)], "table string, columns array<string>, keys bigint")
    counted, plain_counts, plain_masks = [], keyrows.key_counts, keyrows.key_masks

    def key_counts(spark, tables, sets):
        counted.extend(sets)
        return plain_counts(spark, tables, sets)

    made = []

    def key_masks(*arguments):
        frame = plain_masks(*arguments)
        made.append(frame.count())
        return frame

    monkeypatch.setattr(keyrows, "key_counts", key_counts)
    monkeypatch.setattr(keyrows, "key_masks", key_masks)
    found = {tuple(r.right): r for r in keyrows.pair_counts(tables, pairs, known).collect()}
    assert counted == [("small", ("u", "v"))]
    assert sum(made) == 0  # prices begin above all values of the other side
    assert {r: (x.n_left, x.n_right, x.common) for r, x in found.items()} == {tuple(r): (2000, 50, 0) for r in rights}

    # Of one whole price in a hundred rows the matching ones are left.
    near = {"big": spark.range(2000).selectExpr("id AS k", "id / 100 AS price"), "small": tables["small"]}
    rows = {tuple(r.right): r for r in keyrows.pair_counts(near, pairs, known).collect()}
    for r in rows.values():
        assert (r.n_left, r.n_right, r.common, r.full_common) == brute(near, r), r
    assert 0 < sum(made) < 600
