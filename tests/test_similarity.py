"""Similarity joins against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from joinseek.operators import similarity
from joinseek.operators.similarity import jaro_candidates, levenshtein_candidates, similarity_join


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_jaro(a, b):
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, taken = list(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == x:
                free[j] = None
                taken.append(x)
                break
    m = len(taken)
    if not m:
        return 0.0
    back = [y for y, f in zip(b, free, strict=True) if f is None]
    swapped = sum(x != y for x, y in zip(taken, back, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


SCORES = {"Levenshtein": lambda a, b: 1 - edits(a, b) / max(len(a), len(b), 1), "Jaro": plain_jaro}


def words(rnd, letters, number, longest):
    out = ["", "a", "aé", "ü😀x"]
    for _ in range(number):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, longest)))
        out.append(word)
        place = rnd.randrange(len(word))
        out.append(rnd.choice([word[:place] + word[place + 1 :], word[:place] + "q" + word[place:], word[:place] + "é" + word[place + 1 :], word[::-1]]))
    return out


@pytest.mark.parametrize(("method", "minimum", "part"), [("Levenshtein", 0.8, 512), ("Levenshtein", 0.55, 3), ("Jaro", 0.9, 512), ("Jaro", 0.75, 3), ("Jaro", 0.95, 1)])
def test_join_equals_all_pairs(spark, monkeypatch, method, minimum, part):
    monkeypatch.setattr(similarity, "PART", part)
    rnd = random.Random(part)
    pool = words(rnd, "abcdeé", 60, 12) + words(rnd, "ab", 8, 30)
    left, right = pool[::2] + pool[:20], pool[1::2] + pool[::5]
    frames = [spark.createDataFrame([(w,) for w in [*side, None, None]], "`the word` string") for side in (left, right)]
    found = similarity_join(*frames, "the word", "the word", method, minimum)
    got = {(r.left_value, r.right_value): r.score for r in found.collect()}
    want = {(a, b): SCORES[method](a, b) for a in left for b in right}
    if method == "Levenshtein":
        assert found.count() == len(got)
    assert set(got) == {k for k, s in want.items() if s >= minimum}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_long_strings(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefghij klmnop") for _ in range(70)) for _ in range(6)]
    other = [w[:20] + "X" + w[22:50] + w[53:] for w in base[:3]] + base[3:]
    frames = [spark.createDataFrame([(w,) for w in side], "w string") for side in (base, other)]
    for method, minimum in (("Levenshtein", 0.9), ("Jaro", 0.9)):
        got = {(r.left_value, r.right_value) for r in similarity_join(*frames, "w", "w", method, minimum).collect()}
        assert got == {(a, b) for a in base for b in other if SCORES[method](a, b) >= minimum}


def test_candidates_are_few_and_no_pair_is_tried_blindly(spark):
    rnd = random.Random(9)
    pool = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(4, 12))) for _ in range(800)]
    a = spark.createDataFrame([(w,) for w in set(pool[:400])], "a string")
    b = spark.createDataFrame([(w,) for w in set(pool[400:])], "b string")
    assert levenshtein_candidates(a, b, 0.8).distinct().count() < 0.02 * a.count() * b.count()
    assert jaro_candidates(a, b, 0.9).count() < 0.02 * a.count() * b.count()
    for method in ("Levenshtein", "Jaro"):
        plan = similarity_join(a, b, "a", "b", method, 0.9)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides_and_wrong_settings(spark):
    some = spark.createDataFrame([("a",)], "w string")
    for method in ("Levenshtein", "Jaro"):
        assert similarity_join(some, some.where(F.lit(False)), "w", "w", method, 0.9).collect() == []
    for method, minimum in (("Levenshtein", 0.5), ("Jaro", 0.6), ("Semantic", 0.9)):
        with pytest.raises(ValueError):
            similarity_join(some, some, "w", "w", method, minimum)
