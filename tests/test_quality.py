import random

import pandas as pd
import pytest

from joinseek.operators.contribution import join_contribution, join_on
from joinseek.operators.counters import counter_columns, mode_count, useful_columns
from joinseek.operators.profile import profile
from joinseek.plans.registry import candidates
from joinseek.session import settle


def random_frames(spark, seed):
    rng = random.Random(seed)

    def rows(n, hot):
        some = [(rng.randint(0, 6), rng.choice(["a", "b", None]), rng.choice([None, 1.5]), rng.choice([None, "z"])) for _ in range(n)]
        return some + [(hot, "a", None, None)] * (n // 2)  # a third of all rows share one key

    left = spark.createDataFrame(rows(40, 3), "k int, s string, u double, v string")
    right = spark.createDataFrame(rows(30, 3), "key int, s string, w double, v string").selectExpr("CAST(key AS DOUBLE) AS key", "s", "w", "v")
    return left, right


def direct(left, right, l_on, r_on):
    """The join itself, with missing equal to missing."""
    left_rows, right_rows = ([tuple(r) for r in df.collect()] for df in (left, right))
    li, ri = [left.columns.index(c) for c in l_on], [right.columns.index(c) for c in r_on]
    joined = [(a, b) for a in left_rows for b in right_rows if [a[i] for i in li] == [b[i] for i in ri]]
    l_free = [i for i in range(len(left.columns)) if i not in li]
    r_free = [i for i in range(len(right.columns)) if i not in ri]
    r_rows = sum(any(b[i] is not None for i in r_free) for _, b in joined)
    l_rows = sum(any(a[i] is not None for i in l_free) for a, _ in joined)
    return (
        len(joined),
        len(r_free) * r_rows * 100 / (len(left_rows) * len(left.columns)),
        len(l_free) * l_rows * 100 / (len(right_rows) * len(right.columns)),
    )


@pytest.mark.parametrize("seed", range(2))
def test_contribution_equals_the_direct_join(spark, seed):
    left, right = random_frames(spark, seed)
    lists = [(["k"], ["key"]), (["s"], ["s"]), (["k", "s"], ["key", "s"]), (["s", "k", "v"], ["s", "key", "v"])]
    tables = {"l": left, "r": right}
    found = join_contribution(tables, candidates(spark, [("l", "r", a, b) for a, b in lists])).collect()
    assert len(found) == len(lists)
    for r in found:
        rows, right_adds, left_adds = direct(left, right, r.left, r.right)
        assert int(r.joined_rows) == rows
        assert (r.right_adds, r.left_adds) == (pytest.approx(right_adds), pytest.approx(left_adds))


def test_known_complete_columns_save_reading(spark, tmp_path):
    wide = spark.range(30).selectExpr("id % 7 AS k", "id AS full", "IF(id > 3, id, NULL) AS part")
    wide.write.parquet(str(tmp_path / "wide"))
    tables = {"l": spark.read.parquet(str(tmp_path / "wide")), "r": wide.select("k", "part")}
    rows = candidates(spark, [("l", "r", ["k"], ["k"]), ("l", "r", ["full"], ["k"])])
    plain = join_contribution(tables, rows)
    known = join_contribution(tables, rows, settle(profile(tables, distinct=False)))
    assert sorted(map(str, plain.collect())) == sorted(map(str, known.collect()))
    single = join_contribution(tables, rows.where("left[0] = 'k'"), settle(profile(tables, distinct=False)))
    plan = single._jdf.queryExecution().toString()
    assert "ReadSchema: struct<k:bigint>" in plan and "full:bigint" not in plan.split("ReadSchema")[1]


def test_contribution_without_rows_or_candidates(spark):
    tables = {"l": spark.range(0).selectExpr("id", "id AS x"), "r": spark.range(3)}
    row = join_contribution(tables, candidates(spark, [("l", "r", ["id"], ["id"])])).first()
    assert (int(row.joined_rows), row.right_adds, row.left_adds) == (0, 0.0, 0.0)
    assert join_contribution(tables, candidates(spark, [("l", "r", ["id"], ["id"])]).limit(0)).count() == 0


def test_contribution_of_huge_keys_does_not_overflow(spark):
    tables = {"l": spark.range(1).selectExpr("1 AS k", "2 AS x"), "r": spark.range(1).selectExpr("1 AS k", "2 AS x")}
    row = join_contribution(tables, candidates(spark, [("l", "r", ["k"], ["k"])])).first()
    assert row.joined_rows.as_tuple().exponent == 0 and row.right_adds == 50.0


def test_join_on_renames_clashes_and_matches_missing(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(1.0, "x", 7), (None, "y", 8)], "k double, v string, w int")
    found = join_on(left, right, ["k"], ["k"])
    assert found.columns == ["k_left", "v_left", "k_right", "v_right", "w"]
    assert {(r.v_left, r.v_right) for r in found.collect()} == {("a", "x"), ("b", "y")}


def pandas_miss(values):
    steps = pd.Series(sorted(values)).diff().dropna()
    return 1 - steps.value_counts().max() / len(steps)


@pytest.mark.parametrize("partitions", [None, 1, 5, 40])
def test_counters_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(3)
    serial = [10 + 3 * i for i in range(200)]
    noisy = rng.sample(range(10_000), 200)
    repeated = [i // 2 for i in range(200)]
    halves = [i / 2 if i % 20 else i * 1.0 for i in range(200)]
    hot = [7] * 100 + list(range(100))
    rows = list(zip(serial, noisy, repeated, halves, hot, strict=True))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "serial bigint, noisy int, repeated int, halves double, hot int")
    found = {r.column: r for r in counter_columns({"t": df}, settle(profile({"t": df})), min_uniqueness=0.3, partitions=partitions).collect()}
    for i, name in enumerate(df.columns):
        assert found[name].miss == pytest.approx(pandas_miss([r[i] for r in rows])), name
    assert found["serial"].is_counter and not found["noisy"].is_counter


def test_counter_limits(spark):
    df = spark.createDataFrame([(i, i, None, str(i)) for i in range(50)] + [(49, 90, 1, "x")], "a int, b int, c int, s string")
    found = {r.column: r for r in counter_columns({"t": df}, settle(profile({"t": df}))).collect()}
    assert not found["a"].is_counter and found["a"].uniqueness == pytest.approx(50 / 51) and found["a"].miss is None
    assert found["b"].is_counter and found["b"].miss == pytest.approx(1 / 50)
    assert not found["c"].is_counter and not found["s"].is_counter


def test_counter_of_one_value_or_none(spark):
    for rows in ([(5,)], [], [(None,)]):
        df = spark.createDataFrame(rows, "a bigint")
        assert not counter_columns({"t": df}, settle(profile({"t": df}))).first().is_counter


def test_counter_steps_beyond_bigint(spark):
    df = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (0,)], "a bigint")
    assert not counter_columns({"t": df}, settle(profile({"t": df}))).first().is_counter


def test_counter_reads_infinity_and_nan(spark):
    values = [float(i) for i in range(30)] + [float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    row = counter_columns({"t": df}, settle(profile({"t": df})), min_uniqueness=0.9, partitions=4).first()
    assert row.miss == pytest.approx(1 / 30)


def test_mode_count(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3)], "g string, x int")
    assert {tuple(r) for r in mode_count(df, "x", ["g"]).collect()} == {("a", 2), ("b", 1)}
    assert mode_count(df.limit(0), "x").first().mode_count == 0


def test_useful_columns_are_distinct(spark):
    rows = [("a", "b", ["x"], ["u"]), ("a", "b", ["x", "y"], ["u", "v"]), ("a", "b", ["z"], ["w"])]
    report = candidates(spark, rows).selectExpr("*", "left[0] = 'x' AS mergeable")
    found = {(r.side, r.table, r.column) for r in useful_columns(report).collect()}
    assert found == {("left", "a", "x"), ("left", "a", "y"), ("right", "b", "u"), ("right", "b", "v")}


def test_column_names_do_not_clash_with_ours(spark):
    names = ["x0", "b0", "v0", "slot", "__date_reading1"]
    df = spark.range(20).selectExpr(*(f"id * {i + 1} AS `{n}`" for i, n in enumerate(names)), "CAST(id AS STRING) AS x1")
    catalog = settle(profile({"t": df}))
    assert {r.column for r in counter_columns({"t": df}, catalog, partitions=3).where("is_counter").collect()} == set(names)
    tables = {"t": df, "u": df.selectExpr("x0 AS arity", "x1 AS k0")}
    rows = [("t", "u", ["x0", "x1"], ["arity", "k0"]), ("t", "u", ["x1"], ["k0"]), ("t", "u", ["b0"], ["arity"])]
    found = join_contribution(tables, candidates(spark, rows)).collect()
    assert {(tuple(r.left), int(r.joined_rows)) for r in found} == {(("x0", "x1"), 20), (("x1",), 20), (("b0",), 10)}


def test_counter_of_decimals_beyond_doubles(spark):
    df = spark.range(100).selectExpr(
        "CAST(id + 9007199254740992 AS DECIMAL(20, 0)) AS whole",
        "CAST(id AS DECIMAL(30, 2)) * CAST(0.25 AS DECIMAL(3, 2)) AS quarter",
        "CAST(IF(id = 7, NULL, id * id) AS DECIMAL(38, 0)) AS square",
    )
    found = {r.column: r for r in counter_columns({"t": df}, settle(profile({"t": df}))).collect()}
    assert found["whole"].miss == found["quarter"].miss == 0.0 and found["whole"].is_counter
    assert not found["square"].is_counter


def test_join_keys_of_one_type_stay_as_they_are(spark):
    left = spark.createDataFrame([(1, 0.5, "a"), (2, float("nan"), "b")], "k bigint, d double, s string")
    right = spark.createDataFrame([(1, 0.5, "a"), (2, float("nan"), "b")], "q int, e double, t string")
    for a, b in (("k", "q"), ("d", "e"), ("s", "t")):
        assert join_on(left, right, [a], [b]).count() == 2
    plan = join_on(left, right.withColumn("q", right.q.cast("bigint")), ["k"], ["q"])._jdf.queryExecution().toString()
    assert "as string)" not in plan.lower()
