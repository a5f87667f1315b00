import pytest

from joinseek import Params, discover_joins

NAMES = Params(name_methods=(("Levenshtein", 0.5), ("Jaro", 0.8)))


def books_and_reviews(spark):
    """Titles under two names; the joining pair turns up in the last stage."""
    books = [(f"isbn {i:03d}", f"title {i % 57}", 1950 + i % 36, f"genre {i % 22}") for i in range(61)]
    reviews = [(i, "words " * 20, (i % 13) / 2, f"title {i % 85 + 2}", f"{i % 28 + 1:02d}/03/2021") for i in range(98)]
    return {
        "books": spark.createDataFrame(books, "isbn string, title string, year int, genre string"),
        "reviews": spark.createDataFrame(reviews, "nr int, words string, stars double, book string, day string"),
    }


def students_and_exams(spark):
    """A numbered key and its references, not similar by name."""
    students = [(i, f"name {i}", f"{i % 28 + 1}/1/2000") for i in range(1, 401)]
    exams = [(1 + (i * 7) % 377, f"course {i % 58}", i % 13, f"{i % 28 + 1}/{i % 12 + 1}/2021") for i in range(999)]
    return {
        "students": spark.createDataFrame(students, "code int, fullname string, born string"),
        "exams": spark.createDataFrame(exams, "who int, subject string, grade int, at string"),
    }


def merged(found):
    return {(r.stage, tuple(r.left), tuple(r.right)): r.join_score for r in found.mergeable.collect()}


def test_last_stage(spark):
    found = discover_joins(books_and_reviews(spark), params=NAMES)
    assert merged(found) == {("S4", ("title",), ("book",)): pytest.approx(55 / 87)}
    assert {(r.table, r.column) for r in found.dropped.collect()} == {("reviews", "words")}
    report = {(tuple(r.left), tuple(r.right)): r for r in found.report.collect()}
    assert report[("isbn",), ("book",)].stage == "S3" and report[("isbn",), ("book",)].matches == 0
    assert report[("year",), ("nr",)].description == "Pruned SN (0.37)"
    # A candidate is scored once: what failed in S3 does not come back in S4.
    assert len(report) == found.report.count()
    row = found.contribution.first()
    joined = sum(1 for i in range(61) for j in range(98) if i % 57 == j % 85 + 2)
    assert row.right_adds == pytest.approx(4 * joined * 100 / (61 * 4))
    assert row.left_adds == pytest.approx(3 * joined * 100 / (98 * 5))
    assert found.counters.count() == 0


def test_key_stage_and_counter(spark):
    found = discover_joins(students_and_exams(spark), params=NAMES)
    assert merged(found) == {("S3", ("code",), ("who",)): pytest.approx(377 / 400)}
    assert {(r.side, r.column) for r in found.counters.collect()} == {("left", "code")}


def test_pairs_found_from_both_sides_appear_once(spark):
    tables = {"a": spark.range(50).selectExpr("id AS left_number"), "b": spark.range(25, 75).selectExpr("id AS xyz")}
    found = discover_joins(tables, params=NAMES)
    assert found.report.count() == 1 and found.report.first().stage == "S3"


def test_equal_names_with_combination(spark):
    rows = spark.range(60).selectExpr("id % 10 AS p", "id % 12 AS q", "CAST(id AS STRING) AS r")
    other = spark.range(30, 60).selectExpr("id % 10 AS p", "id % 12 AS q", "CAST(-id AS STRING) AS r")
    found = discover_joins({"a": rows, "b": other}, params=NAMES)
    # r fails with 0 matches, so no combination holds it; (p, q) is scored.
    assert merged(found) == {
        ("S1", ("p",), ("p",)): 1.0,
        ("S1", ("q",), ("q",)): 1.0,
        ("S1", ("p", "q"), ("p", "q")): pytest.approx(30 / 60),
    }
    assert found.report.count() == 4


def test_similar_names(spark):
    tables = {"a": spark.range(10).selectExpr("id AS customer_id"), "b": spark.range(9).selectExpr("id AS customerid")}
    found = discover_joins(tables, params=NAMES)
    assert merged(found) == {("S2", ("customer_id",), ("customerid",)): 0.9}
    info = {i.method for i in found.report.first().similarity_info}
    assert info == {"Levenshtein", "Jaro"}


def test_each_table_pair_leaves_at_its_own_stage(spark):
    tables = {**books_and_reviews(spark), **students_and_exams(spark)}
    tables["grades"] = tables["exams"].selectExpr("grade").distinct()
    pairs = [("books", "reviews"), ("students", "exams"), ("grades", "exams")]
    found = discover_joins(tables, pairs, NAMES)
    assert {(r.left_table, r.right_table, r.stage) for r in found.mergeable.collect()} == {
        ("books", "reviews", "S4"),
        ("students", "exams", "S3"),
        ("grades", "exams", "S1"),
    }
    alone = discover_joins({k: tables[k] for k in ("books", "reviews")}, params=NAMES)
    columns = ["stage", "left", "right", "join_score", "matches", "description"]
    mine = found.report.where("left_table = 'books'").select(columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, alone.report.select(columns).collect()))


def test_every_pair_of_tables_by_default(spark):
    tables = {n: spark.range(3 + i).selectExpr(f"id AS {n}_key") for i, n in enumerate("abc")}
    found = discover_joins(tables, params=Params(name_methods=(), min_join=0.1))
    assert {(r.left_table, r.right_table) for r in found.mergeable.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_nothing_in_common(spark):
    tables = {"a": spark.createDataFrame([("x",), ("y",)], "s string"), "b": spark.range(2)}
    found = discover_joins(tables, params=NAMES)
    assert found.mergeable.count() == 0 and found.report.count() == 0
    assert found.counters.count() == 0 and found.contribution.count() == 0
    with pytest.raises(ValueError, match="zz"):
        discover_joins(tables, [("a", "zz")])


def test_cosine_and_merge(spark):
    tables = {"a": spark.range(4).selectExpr("id AS k"), "b": spark.range(10).selectExpr("id AS k")}
    assert discover_joins(tables, params=Params(name_methods=())).mergeable.count() == 0
    found = discover_joins(tables, params=Params(name_methods=(), score_method="cosine", eval_method="Merge"))
    row = found.mergeable.first()
    assert row.join_score == pytest.approx(4 / 40**0.5) and row.description == "Merge"
