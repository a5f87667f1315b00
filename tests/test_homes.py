import random
import tempfile
import time
from itertools import combinations
from pathlib import Path

import pytest

from joinseek.operators import homes, keyrows, levels
from joinseek.session import FREE_SHUFFLES, settle, written

NAMES = ["u", "v", "w", "x", "y"]
SCHEMA = "u int, v int, w string, x int, y double"


def made(seed, n):
    rng = random.Random(seed)
    price = [None, float("nan"), 0.0, -0.0, 0.5, 2.0, 2.25]
    # Half of v is missing, so that one value of a column of many is hot and the others are not.
    return [
        (rng.randrange(n // 3), None if rng.random() < 0.5 else rng.randrange(n), rng.choice([None, "a", "b", "z" * 90]), rng.randint(0, 2), rng.choice(price))
        for _ in range(n)
    ]


def plain(row):
    return tuple(None if v != v else v for v in row)


def brute(sides, columns):
    left, right = ({plain(tuple(r[NAMES.index(c)] for c in names)) for r in rows} for rows, names in zip(sides, columns, strict=True))
    both = left & right
    return len(left), len(right), len(both), sum(None not in k for k in both)


@pytest.mark.parametrize("limit, sliced", [(1, 10**9), (8, 0)])
def test_home_counts_equal_brute_force(spark, monkeypatch, limit, sliced):
    monkeypatch.setattr(homes, "HOT_SHARE", 10)
    monkeypatch.setattr(homes, "PART_ROWS", limit)
    monkeypatch.setattr(homes, "SLICED_ROWS", sliced)
    monkeypatch.setattr(levels, "HOME_ROWS", 0)
    monkeypatch.setattr(levels, "_keys", None)
    rows = {"one": made(1, 90), "two": made(2, 60) + made(1, 90)[:30], "none": []}
    tables = {t: spark.createDataFrame(r, SCHEMA) for t, r in rows.items()}
    listed = [("one", "two", list(c), list(c)) for k in (1, 2, 3) for c in combinations(NAMES, k)]
    listed += [("one", "one", ["v", "x", "y"], ["u", "y", "x"]), ("one", "none", ["v", "x"], ["v", "x"])]
    pairs = spark.createDataFrame(listed, "left_table string, right_table string, left array<string>, right array<string>")
    found = levels.level_counts(tables, pairs).collect()
    assert len(found) == len(listed)
    for r in found:
        expected = brute((rows[r.left_table], rows[r.right_table]), (r.left, r.right))
        assert (r.n_left, r.n_right, r.common, r.full_common) == expected, r


def test_key_counts_by_home_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(homes, "HOT_SHARE", 10)
    monkeypatch.setattr(keyrows, "HOME_ROWS", 50)
    rows = {"one": made(3, 100), "small": made(4, 20)}
    # All rows are alone in u, so that no row is left for the larger sets.
    rows["one"] = [(i, *r[1:]) for i, r in enumerate(rows["one"])]
    tables = {t: spark.createDataFrame(r, SCHEMA) for t, r in rows.items()}
    sets = [(t, c) for t in tables for k in (1, 2, 3) for c in combinations(NAMES, k)]
    found = {(r.table, tuple(r.columns)): r["keys"] for r in keyrows.key_counts(spark, tables, sets).collect()}
    assert found == {(t, c): brute((rows[t], []), (c, c))[0] for t, c in sets}


def test_few_sets_are_dealt_out_once_each(spark, monkeypatch):
    monkeypatch.setattr(keyrows, "HOME_ROWS", 10)
    monkeypatch.setattr(keyrows, "home_sums", None)
    rows = made(4, 200)
    sets = [("t", c) for c in combinations(NAMES, 2)][:4] + [("t", tuple(NAMES[:3]))]
    found = keyrows.key_counts(spark, {"t": spark.createDataFrame(rows, SCHEMA)}, sets).collect()
    assert {("t", tuple(r.columns)): r["keys"] for r in found} == {(t, c): brute((rows, []), (c, c))[0] for t, c in sets}


def test_rows_are_shuffled_per_home_and_not_per_set(spark, monkeypatch):
    monkeypatch.setattr(homes, "HOT_SHARE", 10)
    rows = [(i, i // 2, "a", i % 3, 0.5) for i in range(300)]
    seen, plain_count = [], homes._home

    def counted(typed, held, sets, home, order, *rest):
        frame = plain_count(typed, held, sets, home, order, *rest)
        if frame is not None:
            seen.append(home)
        return frame

    monkeypatch.setattr(homes, "_home", counted)
    df = spark.createDataFrame(rows, SCHEMA)
    sets = {i: c for i, c in enumerate(c for k in (2, 3) for c in combinations(range(5), k))}
    found = {r.id: r.more_left for r in homes.home_sums([homes.Side(0, df, NAMES)], sets, 300, 4).collect()}
    assert sorted(seen) == [0, 1]  # twenty sets, two shuffles: w, x and y hold hot values only
    for i, places in sets.items():
        assert found[i] == len({tuple(r[p] for p in places) for r in rows}) - 300


def test_written_steps_free_their_shuffles(spark):
    folder = Path(spark.conf.get("spark.local.dir", None) or tempfile.gettempdir())

    def files():
        return {f for f in folder.glob("blockmgr-*/*/shuffle_*.data")}

    before, was = files(), spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(300000).repartition(4, "id").selectExpr("id % 200000 AS id").groupBy("id").count()
    for keep in (written, settle):
        assert keep(rows).count() == 200000
    size = None
    for _ in range(50):  # files are deleted in the background
        if (size := sum(f.stat().st_size for f in files() - before if f.exists())) < 100_000:
            break
        time.sleep(0.1)
    assert size < 100_000  # those of the counts; the steps shuffle over a megabyte each
    assert spark.conf.get(FREE_SHUFFLES, None) == was


@pytest.mark.parametrize("buckets", [1, 64])
def test_wide_sets_alone_count_no_value_that_is_not_hot(spark, monkeypatch, buckets):
    """With one bucket per hot value at most, values that are not hot share buckets with those that are."""
    monkeypatch.setattr(homes, "HOT_SHARE", 10)
    monkeypatch.setattr(homes, "BUCKETS", buckets, raising=False)
    monkeypatch.setattr(homes, "_value_counts", None)
    rows = {"one": made(7, 90), "two": made(8, 60) + made(7, 90)[:30]}
    sides = [homes.Side(k, spark.createDataFrame(r, SCHEMA), NAMES) for k, r in enumerate(rows.values())]
    sets = dict(enumerate(c for k in (2, 3) for c in combinations(range(5), k)))
    found = {r.id: r for r in homes.home_sums(sides, sets, 180, 4).collect()}
    for i, places in sets.items():
        names = [NAMES[p] for p in places]
        r, expected = found[i], brute(rows.values(), (names, names))
        assert (90 + r.more_left, 90 + r.more_right, r.common, r.full_common) == expected


def test_hot_values_are_those_of_the_full_count(spark, monkeypatch):
    monkeypatch.setattr(homes, "HOT_SHARE", 10)
    rows = made(9, 200)
    side = homes.Side(0, spark.createDataFrame(rows, SCHEMA), NAMES)
    held = {p: [x for x in homes.PARTS if x in side.parts(p)] for p in range(5)}
    typed = [homes._typed(side, held)]

    def told(found):
        return {r.place: ({(v.l, v.d, v.s) for v in r.hot}, r.keys > len(r.hot)) for r in found}

    expected = told(homes._value_counts(typed, held, 200))
    assert told(homes._hot_values(typed, held, 200)) == expected
    assert {others for _, others in expected.values()} == {False, True}
