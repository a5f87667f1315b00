import random
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from joinseek.functions.dates import DAY_FIRST, MONTH_FIRST, date_reading
from joinseek.functions.strings import string_similarity
from joinseek.functions.values import join_key, key_parts
from joinseek.operators.overlap import two_decimals


def key_of(spark, value, kind):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(F.expr(join_key("x", df.schema["x"].dataType))).first()[0]


@pytest.mark.parametrize(
    "one, other",
    [
        ((3, "int"), (3.0, "double")),
        ((0, "bigint"), (-0.0, "double")),
        ((Decimal("3.00"), "decimal(10,2)"), (3, "bigint")),
        ((Decimal("0.50"), "decimal(10,2)"), (0.5, "double")),
        ((Decimal("0.50"), "decimal(10,2)"), (Decimal("0.5000"), "decimal(30,4)")),
        ((Decimal("12345678901234567890.12"), "decimal(30,2)"), (Decimal("12345678901234567890.1200"), "decimal(34,4)")),
        ((date(2020, 1, 2), "date"), (datetime(2020, 1, 2), "timestamp_ntz")),
        ((date(2020, 1, 2), "date"), ("2020-01-02", "string")),
        ((datetime(2020, 1, 2, 3, 4, 5, 600), "timestamp"), (datetime(2020, 1, 2, 3, 4, 5, 600), "timestamp_ntz")),
        ((-(2**63), "bigint"), (-(2.0**63), "double")),
        ((2**63 - 1024, "bigint"), (2.0**63 - 1024, "double")),
    ],
)
def test_equal_values_give_equal_keys(spark, one, other):
    assert key_of(spark, *one) == key_of(spark, *other)


def test_unequal_values_give_unequal_keys(spark):
    close = [(2**53, "bigint"), (2**53 + 1, "bigint"), (0.1, "double"), (0.1 + 2e-17 * 2, "double"), (None, "double")]
    keys = [key_of(spark, *v) for v in close]
    assert len(set(keys)) == 5 and keys[-1] is None
    assert key_of(spark, float("nan"), "double") is None
    assert key_of(spark, "007", "string") != key_of(spark, "7", "string")
    long_ones = [Decimal("12345678901234567890.12"), Decimal("12345678901234567890.13")]
    assert len({key_of(spark, v, "decimal(30,2)") for v in long_ones}) == 2


@pytest.mark.parametrize("value", [0.0, -0.0, 1.5, -2.0, 1e300, float("inf"), float("nan"), None, 2.0**60, 2.0**63, -(2.0**63)])
def test_at_most_one_part_holds_a_number(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    parts = key_parts("x", df.schema["x"].dataType)
    row = df.selectExpr(*(f"{e} AS {p}" for p, e in parts.items())).first()
    held = [v for v in row if v is not None]
    missing = value is None or value != value
    assert len(held) == (0 if missing else 1)
    if not missing:
        assert held[0] == value


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1,)], ["a.b`c"])
    assert df.select(F.expr(join_key("a.b`c", df.schema[0].dataType))).first()[0] == "1"


@pytest.mark.parametrize(
    "value, day_first, month_first",
    [
        ("29/02/2021", False, False),
        ("29/02/2020", True, False),
        ("02/29/2020", False, True),
        ("1.2.2020", True, True),
        ("1-2.2020", False, False),
        ("2020-02-29", True, True),
        ("2021-02-29", False, False),
        (" 2020-01-01T10:20:30.5Z ", True, True),
        ("1/2/2020 25:00", False, False),
        ("123-45-6789", False, False),
        ("978-0-12-345", False, False),
        ("May 5, 2020", False, False),
        ("", False, False),
        (None, False, False),
    ],
)
def test_date_reading(spark, value, day_first, month_first):
    df = spark.createDataFrame([(value,)], "x string")
    found = df.select(F.expr(date_reading("x"))).first()[0]
    assert found == DAY_FIRST * day_first + MONTH_FIRST * month_first


def test_similarities_agree_with_duckdb(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(1200)]
    pairs = list(zip(words[::2], words[1::2], strict=True)) + [("martha", "marhta"), ("same", "same"), ("a", "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    methods = ("Levenshtein", "Jaro", "Equality")
    rows = df.select("a", "b", *(string_similarity("a", "b", m)["score"].alias(m) for m in methods)).collect()
    for r in rows:
        sql = "SELECT 1 - levenshtein(?, ?) / greatest(length(?), length(?)), jaro_similarity(?, ?), ? = ?"
        lev, jar, same = duckdb.execute(sql, [r.a, r.b] * 4).fetchone()
        assert r.Levenshtein == pytest.approx(lev) and r.Jaro == pytest.approx(jar) and r.Equality == same


def test_empty_and_missing_strings(spark):
    df = spark.createDataFrame([("", ""), ("", "a"), (None, "a")], "a string, b string")
    rows = df.select(*(string_similarity("a", "b", m)["score"] for m in ("Levenshtein", "Jaro"))).collect()
    assert [tuple(r) for r in rows] == [(1.0, 0.0), (0.0, 0.0), (None, None)]


def test_similarity_is_case_sensitive_and_knows_its_methods(spark):
    df = spark.createDataFrame([("A", "a")], "a string, b string")
    assert df.select(string_similarity("a", "b")["score"]).first()[0] == 0.0
    with pytest.raises(ValueError, match="Hamming"):
        string_similarity("a", "b", "Hamming")


def test_two_decimals_rounds_like_python(spark):
    values = sorted({a / b for b in range(1, 301) for a in range(b + 1)})
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for value, shown in df.select("x", F.expr(two_decimals("x"))).collect():
        assert shown == f"{value:.2f}"
