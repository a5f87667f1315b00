from datetime import datetime

import pytest

from joinseek.operators import profile as profiles
from joinseek.operators.profile import (
    SKETCH_ERROR,
    group_by_category,
    merged_sketches,
    profile,
    shape,
    sketch_catalog,
    sketched_distinct,
)
from joinseek.operators.prune import (
    cardinality_discards,
    cardinality_kept,
    drop_properties,
    project,
    prune_category,
    prune_length,
    prune_missing,
    prune_uniqueness,
)
from joinseek.plans.discover import pair_table
from joinseek.session import settle

SCHEMA = (
    "flag boolean, maybe boolean, n int, x double, s string, d string, half string, empty string, t timestamp_ntz, "
    "list array<int>"
)


@pytest.fixture(scope="module")
def table(spark):
    day = datetime(2020, 1, 1)
    rows = [
        (True, None, 1, 1.5, "ab", "13/01/2020", "2020-01-01", None, day, [1]),
        (False, True, 1, float("nan"), "abcd", "14/01/2020", "2020-01-02", None, None, [1]),
        (True, False, 2, None, None, "15/01/2020", None, None, day, [2]),
        (True, True, 3, 1.5, "ab", "nonsense", None, None, day, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(catalog):
    return {r.column: r for r in catalog.collect()}


def test_large_tables_are_counted_column_by_column(table, monkeypatch):
    """The other test of these counts, on this way: no row per value is made."""
    monkeypatch.setattr(profiles, "COLUMN_ROWS", 4, raising=False)
    monkeypatch.setattr(profiles, "COLUMNS_PER_JOB", 3, raising=False)
    monkeypatch.setattr(profiles, "_slot_values", None)
    test_profile_counts_and_categories(table)


def test_profile_counts_and_categories(table):
    found = rows_of(profile({"t": table}))
    expected = {
        # column: category, missing, distinct, mean characters
        "flag": ("Boolean", 0, 2, None),
        "maybe": ("Boolean", 1, 2, None),
        "n": ("Numerical", 0, 3, None),
        "x": ("Numerical", 2, 1, None),
        "s": ("Text", 1, 2, 8 / 3),
        "d": ("Date", 0, 4, None),
        "half": ("Text", 2, 2, 10.0),
        "empty": ("Text", 4, 0, None),
        "t": ("Date", 1, 1, None),
        "list": ("Text", 1, 2, None),
    }
    for name, (category, missing, distinct, chars) in expected.items():
        row = found[name]
        assert (row.category, row.missing, row.distinct) == (category, missing, distinct), name
        assert row.avg_chars == (pytest.approx(chars) if chars else chars), name
        assert row.rows == 4


def test_date_needs_more_than_half_of_all_rows(spark):
    rows = [("2020-01-01",), ("2020-01-02",), ("x",), (None,)]
    assert rows_of(profile({"t": spark.createDataFrame(rows, "c string")}))["c"].category == "Text"
    rows = [("2020-01-01",), ("31/12/2020",), ("12/31/2020",), (None,)]
    assert rows_of(profile({"t": spark.createDataFrame(rows, "c string")}))["c"].category == "Text"
    rows = [("2020-01-01",), ("31/12/2020",), ("30/12/2020",), (None,)]
    assert rows_of(profile({"t": spark.createDataFrame(rows, "c string")}))["c"].category == "Date"


def test_empty_table(spark):
    catalog = settle(profile({"t": spark.createDataFrame([], "a int, b string")}))
    found = rows_of(catalog)
    assert found["a"].rows == 0 and found["a"].distinct == 0 and found["b"].category == "Text"
    assert prune_missing(catalog, 0.3)[0].count() == 0


def test_several_tables_in_one_catalogue(spark, table):
    other = spark.range(5)
    catalog = profile({"t": table, "other": other})
    assert catalog.where("table = 'other'").first().distinct == 5
    groups = {(r.table, r.category): r.columns for r in group_by_category(catalog).collect()}
    assert groups["t", "Numerical"] == ["n", "x"] and groups["other", "Numerical"] == ["id"]
    assert groups["t", "Text"] == ["s", "half", "empty", "list"]
    assert {tuple(r) for r in shape({"t": table, "other": other}).collect()} == {("t", 4, 10), ("other", 5, 1)}


def test_prune_missing_is_strict(table):
    catalog = settle(profile({"t": table}, distinct=False))
    kept, dropped = prune_missing(catalog, 0.25)
    assert {r.column for r in kept.collect()} == {"flag", "n", "d"}
    assert {r.column: (r.missing, r.value) for r in dropped.collect()}["x"] == (2, 0.5)


def test_prune_length_scopes(table):
    catalog = settle(profile({"t": table}, distinct=False))
    _, dropped = prune_length(catalog, 10)
    # An all-null string column has no mean length and goes; dates count here.
    assert {r.column for r in dropped.collect()} == {"half", "empty"}
    assert "d" in {r.column for r in prune_length(catalog, 9)[1].collect()}
    _, dropped = prune_length(catalog, 10, scope="text")
    assert {r.column for r in dropped.collect()} == {"half"}
    with pytest.raises(ValueError):
        prune_length(catalog, 10, scope="other")


def test_prune_uniqueness(table):
    catalog = settle(profile({"t": table}))
    assert {r.column for r in prune_uniqueness(catalog, 2)[0].collect()} == {"n", "d"}
    assert {r.column for r in prune_uniqueness(catalog, 1, 0.75)[0].collect()} == {"d"}
    assert prune_uniqueness(catalog, 0, 0)[1].count() == 0


def test_prune_category_and_projection(spark, table):
    tables = {"t": table, "u": spark.createDataFrame([(1, "a")], "k int, w string")}
    catalog = settle(profile(tables, distinct=False))
    kept, dropped = prune_category(catalog, pair_table(spark, [("t", "u")]))
    assert {r.column for r in dropped.collect()} == {"flag", "maybe", "d", "t"}
    assert {(r.side, r.column) for r in kept.where("table = 'u'").collect()} == {("right", "k"), ("right", "w")}
    rest = drop_properties(catalog, dropped)
    assert project(tables, rest)["t"].columns == ["n", "x", "s", "half", "empty", "list"]


def test_cardinality_discards(spark):
    tables = {"a": spark.range(10).selectExpr("id", "id % 2 AS two"), "b": spark.range(4)}
    catalog = settle(profile(tables))
    pairs = pair_table(spark, [("a", "b")])
    found = {(r.left_column, r.right_column) for r in cardinality_discards(catalog, pairs, 0.45).collect()}
    assert found == {("id", "id")}
    assert cardinality_discards(catalog, pairs, 0.0).count() == 0


@pytest.mark.parametrize("score", [0.05, 0.45, 0.9])
def test_cardinality_kept_is_what_is_not_discarded(spark, score):
    rows = [(t, f"{t}{k}", d) for t in "ab" for k, d in enumerate([0, 0, 1, 1, 2, 3, 4, 9, 10, 20, 22, 44, 45, 100, 1000, 2222, None])]
    catalog = spark.createDataFrame(rows, "table string, column string, distinct bigint")
    pairs = spark.createDataFrame([("a", "b")], "left_table string, right_table string")
    kept = cardinality_kept(catalog, pairs, score)
    found = {(r.left_column, r.right_column) for r in kept.collect()}
    counts = {c: d for _, c, d in rows if d is not None}
    assert found == {(x, y) for x in counts for y in counts if x[0] < y[0] and min(counts[x], counts[y]) >= max(counts[x], counts[y]) * score}
    assert kept.count() == len(found)
    with pytest.raises(ValueError):
        cardinality_kept(catalog, pairs, 1.0)


def test_sketches_merge(spark):
    whole = spark.range(30_000).selectExpr("id", "CAST(id % 700 AS STRING) AS word", "IF(id % 3 = 0, NULL, id / 2) AS half", "CAST(NULL AS INT) AS none")
    parts = [sketch_catalog({"t": whole.where(f"id % 3 = {k}")}) for k in range(3)]
    found = {r.column: r for r in sketched_distinct(merged_sketches(parts)).collect()}
    for name, distinct, missing in [("id", 30_000, 0), ("word", 700, 0), ("half", 20_000, 10_000), ("none", 0, 30_000)]:
        assert abs(found[name].distinct - distinct) <= SKETCH_ERROR * distinct
        assert (found[name].rows, found[name].missing) == (30_000, missing)
