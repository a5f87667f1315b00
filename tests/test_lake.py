"""Overlaps of a lake against all pairs of columns."""

import random

import pytest

from joinseek.operators.lake import lake_overlap, prefix_candidates, signatures
from joinseek.operators.profile import profile


def lake(spark, seed, tables=6, columns=4, rows=60):
    rnd = random.Random(seed)
    made = {}
    for k in range(tables):
        starts = [rnd.choice([0, 0, 20, 50, 1000 * k]) for _ in range(columns)]
        data = [
            tuple(None if rnd.random() < 0.1 else kind(start + rnd.randrange(rows)) for kind, start in zip([int, float, str, str], starts, strict=False))
            for _ in range(rows)
        ]
        made[f"t{k}"] = (data, spark.createDataFrame(data, "a int, `b.c` double, d string, e string"))
    return made


def all_pairs(made, least):
    sets = {(t, c, i > 1): [r[i] for r in data] for t, (data, _) in made.items() for i, c in enumerate(["a", "b.c", "d", "e"])}
    found = {}
    for (t, c, words), x in sets.items():
        for (u, d, others), y in sets.items():
            if t < u and words == others:
                common = len({v for v in x if v is not None} & {v for v in y if v is not None})
                total = len(set(x)) + len(set(y)) - common
                if common / total >= least:
                    found[t, c, u, d] = (common, total, common / total)
    return found


@pytest.mark.parametrize("least", [0.05, 0.45, 0.8, 1.0])
def test_overlaps_equal_all_pairs(spark, least):
    made = lake(spark, int(100 * least))
    tables = {t: df for t, (_, df) in made.items()}
    found = lake_overlap(tables, profile(tables, distinct=False), least).collect()
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found} == all_pairs(made, least)


def test_most_pairs_are_not_counted(spark):
    tables = {}
    for k in range(8):
        own = [(1000 * k + i, f"x{1000 * k + i}", i % 7) for i in range(200)]
        tables[f"t{k}"] = spark.createDataFrame(own, "id int, word string, few int")
    tables["copy"] = tables["t3"].selectExpr("id AS other_id", "word")
    catalog = profile(tables, distinct=False)
    held, numbers = signatures(tables, catalog)
    candidates = prefix_candidates(held, numbers, 0.5)
    names = {r.number: (r.table, r.column) for r in numbers.collect()}
    pairs = {(names[r.first], names[r.second]) for r in candidates.collect()}
    few = {((f"t{i}", "few"), (f"t{j}", "few")) for i in range(8) for j in range(i + 1, 8)}
    assert pairs == few | {(("copy", "other_id"), ("t3", "id")), (("copy", "word"), ("t3", "word"))}
    assert {tuple(r)[:4] for r in lake_overlap(tables, catalog, 0.5).collect()} == {(*a, *b) for a, b in pairs}


def test_empty_and_missing_columns(spark):
    tables = {
        "a": spark.createDataFrame([], "x int, y string"),
        "b": spark.createDataFrame([(None, None)], "x int, y string"),
        "c": spark.createDataFrame([(None, None), (None, "u")], "x int, y string"),
    }
    assert lake_overlap(tables, profile(tables, distinct=False), 0.3).collect() == []
    with pytest.raises(ValueError):
        lake_overlap(tables, profile(tables, distinct=False), 0.0)
