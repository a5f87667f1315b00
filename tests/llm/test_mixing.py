import hashlib
import random

import pytest
from pyspark.sql import functions as F

from joinseek.llm.mixing import MixParams, leaf_budgets, mixed, selection

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shares(children, budget):
    """Water filling by repeated rounds: {name: (weight, capacity)} to {name: share}."""
    given, open_names = dict.fromkeys(children, 0.0), {n for n, (w, _) in children.items() if w > 0}
    while open_names and budget > 1e-9:
        weight = sum(children[n][0] for n in open_names)
        full = {n for n in open_names if given[n] + budget * children[n][0] / weight >= children[n][1] - 1e-9}
        if not full:
            for n in open_names:
                given[n] += budget * children[n][0] / weight
            break
        for n in full:
            budget -= children[n][1] - given[n]
            given[n] = children[n][1]
        open_names -= full
        # Shares are counted anew among those that are left.
        budget += sum(given[n] for n in open_names)
        for n in open_names:
            given[n] = 0.0
    return given


@pytest.mark.parametrize("seed", range(4))
def test_budgets_fill_siblings_before_ancestors(spark, seed):
    draw = random.Random(seed)
    weights = {"domain": {"a": 3.0, "b": 1.0, "c": 0.0}, "lang": {"en": 2.0}, "source": {"s1": 0.5}}
    rows = [(d, la, s, draw.choice([0, 5, 50, 500])) for d in "abc" for la in ("en", "de") for s in ("s1", "s2", "s3")]
    params = MixParams(weights=weights, budget=float(draw.choice([10, 300, 2000, 10**6])), max_epochs=2)
    found = leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint"), params)
    got = {(r.domain, r.lang, r.source): r.budget for r in found.collect()}

    def node(level, name, path):
        inside = [t * 2 for *p, t in rows if tuple(p[: len(path) + 1]) == (*path, name)]
        return weights[level].get(name, 1.0), float(sum(inside))

    want = {}
    for d, given in shares({d: node("domain", d, ()) for d in "abc"}, params.budget).items():
        for la, more in shares({x: node("lang", x, (d,)) for x in ("en", "de")}, given).items():
            for s, last in shares({x: node("source", x, (d, la)) for x in ("s1", "s2", "s3")}, more).items():
                want[d, la, s] = last
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1 for k in want)


def prefix(docs, budgets, seed, epochs_key):
    """Copies by hand: {(doc_id, epoch): words taken}."""
    chosen = {}
    for leaf, budget in budgets.items():
        mine = [(i, n, text) for i, n, where, text in docs if where == leaf]
        tokens = sum(n for _, n, _ in mine)
        full, rest = divmod(budget, max(tokens, 1))
        for epoch in range(full):
            chosen.update({(i, epoch): n for i, n, _ in mine})

        def place(doc, full=full):
            return hashlib.md5(f"{seed}:{full}:{doc[0]}:{hashlib.md5(doc[2].encode()).hexdigest()}".encode()).hexdigest()

        for i, n, _ in sorted(mine, key=place):
            if rest <= 0:
                break
            chosen[i, full] = min(n, rest)
            rest -= n
    return chosen


@pytest.mark.parametrize(("budget", "epochs"), [(0.3, 1), (0.9, 3), (700.0, 2), (10.0**6, 2), (0.0, 1)])
def test_selection_is_a_seeded_prefix(spark, budget, epochs):
    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.randint(1, 9)), draw.choice(["en", "de"]), draw.choice(["src1", "src2"]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    params = MixParams(weights={"lang": {"en": 3.0}}, budget=budget, max_epochs=epochs, steps=1)
    counted = [(i, len(t.split()), ("", la, s), t) for i, t, la, s, _ in rows]
    leaves = {}
    for _, n, where, _ in counted:
        leaves[where] = leaves.get(where, 0) + n
    table = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens bigint")
    budgets = {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(table, params).collect()}
    got = {(r.doc_id, r.epoch): r.n_taken for r in selection(docs, params).collect()}
    assert got == prefix(counted, budgets, params.seed, epochs)
    whole = mixed(docs, params).collect()
    assert {(r.doc_id, r.epoch): r.n_taken for r in whole} == got


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3), (3, "c " * 5000, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("epoch", F.lit("x")).withColumn("before", F.lit(1))
    params = MixParams(budget=10.0**9, max_epochs=1)
    out = mixed(docs, params)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "before", "epoch", "n_taken"]
    # A leaf without a word has no budget to take anything with.
    assert sorted((r.doc_id, r.n_taken) for r in out.collect()) == [(1, 0), (2, 2), (2, 2), (3, 5000)]
    assert selection(docs.limit(0), params).count() == 0


def test_leaves_of_weight_0_are_no_capacity(spark):
    rows = [("a", "en", "s", 10), ("a", "de", "s", 1000), ("b", "en", "s", 1000), ("b", "en", "none", 1000), ("c", "de", "s", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens bigint")
    weights = {"lang": {"de": 0.0}, "source": {"none": 0.0}}
    for budget, last in [(600.0, 590), (5000.0, 1000)]:
        found = leaf_budgets(leaves, MixParams(weights=weights, budget=budget, max_epochs=1)).collect()
        got = {(r.domain, r.lang, r.source): r.budget for r in found}
        want = dict.fromkeys([tuple(r[:3]) for r in rows], 0)
        assert got == want | {("a", "en", "s"): 10, ("b", "en", "s"): last}


@pytest.mark.parametrize(("budget", "steps"), [(3.0, 1), (121.0, 2)])
def test_shared_keys_and_equal_rows_do_not_overspend(spark, budget, steps):
    texts = [f"one two three w{k}" for k in range(50)]
    rows = [(None, t, "en", "s", 0) for t in texts] + [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    rows += [(None, "the same four words", "de", "s", 0)] * 60 + [(7, "the same four words", "de", "s", 0)] * 40
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    params = MixParams(weights={"lang": {"en": 1.0, "de": 1.0}}, budget=2 * budget, max_epochs=1, steps=steps)
    for found in (selection(docs, params), mixed(docs, params)):
        taken = {la: [r.n_taken for r in found.collect() if r.lang == la] for la in ("en", "de")}
        for la in taken:
            assert sum(taken[la]) == int(budget) and sum(n < 4 for n in taken[la]) == (budget % 4 > 0)
