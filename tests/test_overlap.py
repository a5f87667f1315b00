import math
import random

import duckdb
import pytest

import joinseek.operators.keyrows as keyrows
from joinseek.operators.candidates import (
    column_combinations,
    hier_discard,
    hier_parents,
    hier_singles,
    split_by_parents,
    without_known,
)
from joinseek.operators.names import common_columns, similar_columns
from joinseek.operators.overlap import listing, measure_overlap, useful
from joinseek.operators.profile import profile
from joinseek.plans.discover import pair_table
from joinseek.plans.registry import candidates
from joinseek.session import settle


def random_table(spark, seed, names):
    rng = random.Random(seed)
    kinds = {"i": lambda: rng.randint(0, 9), "f": lambda: rng.choice([1.0, 2.0, 2.5, 3.25]), "s": lambda: rng.choice("abcdef")}
    types = {"i": "bigint", "f": "double", "s": "string"}
    rows = [tuple(None if rng.random() < 0.15 else kinds[n[0]]() for n in names) for _ in range(60)]
    # A third of all rows hold one and the same value.
    rows += [tuple(kinds[n[0]]() if n[1] == "9" else {"i": 5, "f": 2.0, "s": "c"}[n[0]] for n in names)] * 30
    return spark.createDataFrame(rows, ", ".join(f"{n} {types[n[0]]}" for n in names)), rows


def brute(left, right, method, score_method, min_join):
    l, r = set(left), set(right)
    nl, nr = len(l), len(r)
    bound = min(nl, nr) / (max(nl, nr) if score_method == "jaccard" else math.sqrt(nl * nr))
    if bound < min_join:
        return 0.0, 0, 0.0, f"Pruned SN ({bound:.2f})"
    common = {t for t in l & r if method == "Merge" or None not in t}
    total = nl + nr - len(common) if score_method == "jaccard" else math.sqrt(nl * nr)
    return len(common) / total, len(common), total, "Merge" if method == "Merge" else "Sorted Neighbourhood"


@pytest.mark.parametrize("method", ["Merge", "SortedNeighborhood"])
@pytest.mark.parametrize("score_method", ["jaccard", "cosine"])
@pytest.mark.parametrize("known", [True, False])
def test_overlap_agrees_with_brute_force(spark, method, score_method, known):
    names = ["i1", "i2", "f1", "f2", "s1", "s2"]
    (a, a_rows), (b, b_rows) = random_table(spark, 1, names), random_table(spark, 2, names)
    tables = {"a": a, "b": b}
    lists = [["i1"], ["f1"], ["s1"], ["i1", "s2"], ["f1", "i2"], ["i1", "f2", "s1"]]
    wanted = [(x, y) for x in lists for y in lists if [n[0] in "if" for n in x] == [n[0] in "if" for n in y]]
    catalog = settle(profile(tables, distinct=known))
    report = measure_overlap(
        tables, candidates(spark, [("a", "b", x, y) for x, y in wanted]), catalog, 0.3, method, score_method
    ).collect()
    assert len(report) == len(wanted)
    for r in report:
        side = [[tuple(row[names.index(c)] for c in cols) for row in rows] for cols, rows in ((r.left, a_rows), (r.right, b_rows))]
        score, matches, total, description = brute(*side, method, score_method, 0.3)
        assert (r.matches, r.description) == (matches, description), (r.left, r.right)
        assert r.join_score == pytest.approx(score) and r.total == pytest.approx(total)
        assert r.mergeable == (score >= 0.3 and "Pruned" not in description)


def test_jaccard_is_symmetric_and_in_range(spark):
    names = ["i1", "f1"]
    (a, _), (b, _) = random_table(spark, 3, names), random_table(spark, 4, names)
    rows = [(x, y, [n], [m]) for x, y in (("a", "b"), ("b", "a")) for n in names for m in names]
    catalog = settle(profile({"a": a, "b": b}, distinct=False))
    report = measure_overlap({"a": a, "b": b}, candidates(spark, rows), catalog, 0.0).collect()
    scores = {(r.left_table, *r.left, *r.right): r.join_score for r in report}
    for n in names:
        for m in names:
            assert scores["a", n, m] == scores["b", m, n]
            assert 0 <= scores["a", n, m] <= 1


def test_many_column_sets_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(keyrows, "SETS_PER_PASS", 40)
    wide = spark.range(20).selectExpr(*(f"id + {i} AS c{i}" for i in range(70)))
    other = spark.range(30)
    tables = {"wide": wide, "other": other, "third": spark.range(25)}
    rows = [("wide", t, [f"c{i}"], ["id"]) for t in ("other", "third") for i in range(70)]
    catalog = settle(profile(tables, distinct=False))
    report = measure_overlap(tables, candidates(spark, rows), catalog, 0.0).collect()
    assert len(report) == 140
    for r in report:
        start, size = int(r.left[0][1:]), 30 if r.right_table == "other" else 25
        assert r.matches == len(set(range(start, start + 20)) & set(range(size)))


def test_reasons_come_without_reading_data(spark):
    tables = {"a": spark.range(5).selectExpr("id", "CAST(id AS STRING) AS s"), "b": spark.range(5)}
    rows = [("a", "b", ["id", "s"], ["id"]), ("a", "b", ["nope"], ["id"]), ("a", "b", ["s"], ["id"]), ("a", "zz", ["id"], ["id"])]
    catalog = settle(profile(tables, distinct=False))
    report = measure_overlap(tables, candidates(spark, rows), catalog, 0.0)
    found = [r.description for r in report.collect()]
    assert sorted(found) == sorted(
        ["error - length mismatch", "error - wrong column names", "Category mismatch: Text-Numerical", "error - wrong column names"]
    )
    # A failed candidate scores 0 and is not mergeable even where 0 would do.
    assert useful(report)[0].count() == 0 and useful(report)[1].count() == 4


def test_empty_input(spark):
    tables = {"a": spark.range(0), "b": spark.range(5)}
    catalog = settle(profile(tables, distinct=False))
    row = measure_overlap(tables, candidates(spark, [("a", "b", ["id"], ["id"])]), catalog, 0.0).first()
    assert (row.join_score, row.matches, row.description, row.mergeable) == (0.0, 0, "empty input", False)


def test_unknown_methods_are_errors(spark):
    tables = {"a": spark.range(3), "b": spark.range(3)}
    catalog = settle(profile(tables, distinct=False))
    rows = candidates(spark, [("a", "b", ["id"], ["id"])])
    with pytest.raises(ValueError):
        measure_overlap(tables, rows, catalog, eval_method="Hash")
    with pytest.raises(ValueError):
        measure_overlap(tables, rows, catalog, score_method="dice")
    with pytest.raises(ValueError, match="Hamming"):
        similar_columns(catalog, pair_table(spark, [("a", "b")]), [("Hamming", 0.5)])


def test_listing(spark):
    tables = {"a": spark.range(4), "b": spark.range(5)}
    catalog = settle(profile(tables, distinct=False))
    report = measure_overlap(tables, candidates(spark, [("a", "b", ["id"], ["id"])]), catalog)
    assert listing(report).first().line == "Left: id Right: id Join score: 80.00 (4 / 5) Sorted Neighbourhood"


def names_catalog(spark, **tables):
    return settle(profile({t: spark.createDataFrame([(1,) * len(c)], c) for t, c in tables.items()}, distinct=False))


def test_names(spark):
    catalog = names_catalog(spark, a=["id", "name", "city"], b=["id", "names", "town"], c=["id"])
    pairs = pair_table(spark, [("a", "b")])
    assert [(r.left, r.right) for r in common_columns(catalog, pairs).collect()] == [(["id"], ["id"])]
    found = {
        (r.left[0], r.right[0]): {i.method: i.score for i in r.similarity_info}
        for r in similar_columns(catalog, pairs, [("Levenshtein", 0.5), ("Jaro", 0.8)]).collect()
    }
    assert set(found) == {("id", "id"), ("name", "names")}
    assert found["name", "names"]["Levenshtein"] == pytest.approx(0.8)
    assert set(found["name", "names"]) == {"Levenshtein", "Jaro"}
    # Without a taxonomy the semantic method finds nothing.
    assert similar_columns(catalog, pairs, [("Semantic", 0.5)]).count() == 0


def test_combinations_use_each_column_once(spark):
    rows = [("a", "b", [x], [y]) for x, y in (("p", "u"), ("q", "v"), ("r", "w"), ("p", "w"))]
    found = column_combinations(candidates(spark, rows), [2, 3])
    as_sets = {frozenset(zip(r.left, r.right, strict=True)) for r in found.collect()}
    one, two, three, four = ("p", "u"), ("q", "v"), ("r", "w"), ("p", "w")
    assert as_sets == {
        frozenset(s) for s in ([one, two], [one, three], [two, three], [two, four], [one, two, three])
    }
    assert found.count() == 5
    assert column_combinations(candidates(spark, rows[:1]), [2, 3]).count() == 0


def test_known_candidates_compare_as_sets_but_stay_aligned(spark):
    fresh = candidates(spark, [("a", "b", ["y", "x"], ["u", "v"]), ("a", "b", ["x"], ["u"])])
    known = candidates(spark, [("a", "b", ["x", "y"], ["v", "u"])])
    assert [(r.left, r.right) for r in without_known(fresh, known).collect()] == [(["x"], ["u"])]
    swapped = candidates(spark, [("b", "a", ["x"], ["u"])])
    assert without_known(fresh, swapped).first().left == ["y", "x"]


def test_hierarchical_discard_drops_only_children_of_failed_pairs(spark):
    rows = [("a", "b", [x], [x]) for x in "pqr"]
    singles = candidates(spark, rows)
    report = singles.selectExpr("*", "IF(left[0] = 'p', 1L, 5L) AS matches", "left[0] = 'r' AS mergeable")
    parents = hier_parents(report, 1)
    combos = column_combinations(singles)
    kept = hier_discard(combos, parents)
    assert {tuple(r.left) for r in kept.collect()} == {("q", "r")}
    split = {tuple(r.left): (r.is_child, [p.left for p in r.remaining]) for r in split_by_parents(combos, parents).collect()}
    assert split["p", "q"] == (True, ["q"]) and split["q", "r"] == (False, ["q", "r"])
    # Leaving failed pairs out first gives the same combinations.
    before = column_combinations(hier_singles(singles, parents))
    assert {tuple(r.left) for r in before.collect()} == {("q", "r")}
    assert hier_discard(combos, hier_parents(report, 0)).count() == combos.count()


def test_report_keeps_key_counts(spark):
    tables = {"a": spark.range(4), "b": spark.range(5)}
    catalog = settle(profile(tables, distinct=False))
    row = measure_overlap(tables, candidates(spark, [("a", "b", ["id"], ["id"])]), catalog).first()
    assert (row.left_keys, row.right_keys) == (4, 5)


def test_similar_names_agree_with_all_pairs(spark):
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)})
    left, right = words[::2][:30], words[1::2][:30]
    catalog = names_catalog(spark, a=left, b=right)
    methods = [("Levenshtein", 0.5), ("Jaro", 0.8)]
    found = similar_columns(catalog, pair_table(spark, [("a", "b")]), methods).collect()
    sql = "SELECT 1 - levenshtein(?, ?) / greatest(length(?), length(?)), jaro_similarity(?, ?)"
    expected = {}
    for a in left:
        for b in right:
            scores = duckdb.execute(sql, [a, b] * 3).fetchone()
            reached = {m: s for (m, t), s in zip(methods, scores, strict=True) if s >= t}
            if reached:
                expected[a, b] = reached
    assert {(r.left[0], r.right[0]) for r in found} == set(expected)
    for r in found:
        assert {i.method: i.score for i in r.similarity_info} == pytest.approx(expected[r.left[0], r.right[0]])


def test_long_texts_differ_by_their_last_character(spark):
    base = "é" * 400
    left = [base + "a", base + "b", "x" * 64, "x" * 65, None, base + "a"]
    right = [base + "b", base + "c", "x" * 64, "x" * 65 + " ", None]
    tables = {n: spark.createDataFrame([(v,) for v in rows], "t string") for n, rows in (("a", left), ("b", right))}
    catalog = settle(profile(tables))
    assert {r.table: r.distinct for r in catalog.collect()} == {"a": 4, "b": 4}
    rows = candidates(spark, [("a", "b", ["t"], ["t"])])
    report = measure_overlap(tables, rows, catalog, 0.1).first()
    assert (report.matches, report.left_keys, report.right_keys) == (2, 5, 5)
    assert measure_overlap(tables, rows, catalog, 0.1, "Merge").first().matches == 3
