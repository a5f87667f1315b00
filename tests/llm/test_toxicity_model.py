"""The classifier's counts, ratios and scores, worked out again without Spark."""

import math
import random
import zlib

import numpy as np
import pytest

from joinseek.llm import toxicity
from joinseek.llm.toxicity import ToxicityParams, _logistic, fit, ngrams, score

PARAMS = ToxicityParams(bits=12, max_order=4, rounds=400, false_rate=0.1)


def grams(text):
    return {int(h) for part in ngrams(text, PARAMS) for h in part.tolist()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    made = []
    for doc in range(260):
        toxic = int(rnd.random() < 0.3)
        words = [rnd.choice(["lorem", "ipsum", "dolor", "sit", "amet"] + ["vile", "scum"] * (2 * toxic)) for _ in range(rnd.randrange(3, 30))]
        made.append((doc, " ".join(words), toxic))
    return made


def test_all_ngrams_over_the_rate_with_their_ratio(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = fit(docs, labels, PARAMS)
    learnt = [(grams(t), y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 4 != 2]
    sizes = [sum(y == k for _, y in learnt) for k in (0, 1)]
    seen = {}
    for g, y in learnt:
        for h in g:
            seen.setdefault(h, [0, 0])[y] += 1
    z = {}
    for h, (other, toxic) in seen.items():
        both = (other + toxic) / len(learnt)
        z[h] = abs(toxic / sizes[1] - other / sizes[0]) / math.sqrt(both * (1 - both + 1e-9) * (1 / sizes[0] + 1 / sizes[1]))
    steps = [k / toxicity.STEPS for k in range(int(max(z.values()) * toxicity.STEPS) + 1)]
    allowed = [s for s in steps if len(z) * math.erfc(s / math.sqrt(2)) <= PARAMS.false_rate * sum(v >= s for v in z.values())]
    want = {h for h, v in z.items() if v >= min(allowed)}
    assert set(model.features.tolist()) == want and len(want) > 20

    at = {h: i for i, h in enumerate(model.features.tolist())}
    ratio = np.array([math.log((seen[h][1] + 1) / (sizes[1] + 2)) - math.log((seen[h][0] + 1) / (sizes[0] + 2)) for h in at])
    # The fit is where the gradient of the weighted loss vanishes.
    x = np.array([[ratio[i] if h in g else 0.0 for h, i in at.items()] for g, _ in learnt])
    y = np.array([y for _, y in learnt])
    weight = np.where(y == 1, sum(y) / sizes[1], (len(y) - sum(y)) / sizes[0])
    weight = weight / weight.sum()
    w = model.weights / ratio
    error = weight * (1 / (1 + np.exp(-(x @ w + model.bias))) - y)
    assert np.abs(error @ x + PARAMS.penalty * w).max() < 5e-3 and abs(error.sum()) < 5e-3

    for r in score(docs, model).collect():
        found = sum(model.weights[at[h]] for h in grams(rows[r.doc_id][1]) if h in at)
        assert r.score == pytest.approx(1 / (1 + math.exp(-found - model.bias)), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)


def test_blocks_make_no_difference(monkeypatch):
    rnd = np.random.default_rng(1)
    sizes = np.array([0, 3, 5, 0, 1, 7, 2, 0])
    found = np.concatenate([rnd.choice(9, n, replace=False) for n in sizes]).astype(np.int32)
    args = (found, sizes, rnd.normal(size=9), np.array([0, 1, 0, 0, 1, 1, 0, 1], np.float32), np.full(8, 1 / 8, np.float32), PARAMS)
    whole, bias = _logistic(*args)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    parts, other = _logistic(*args)
    assert np.allclose(whole, parts, atol=1e-5) and abs(bias - other) < 1e-5
