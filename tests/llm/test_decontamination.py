import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from joinseek.llm.decontamination import (
    RADIUS,
    DecontaminationParams,
    _block_values,
    clean_documents,
    contaminated,
)

DRAW = random.Random(3)


def sentence(n):
    return [f"w{DRAW.randint(0, 4000)}" for _ in range(n)]


ITEMS = {i: sentence(n) for i, n in enumerate([15, 22, 30, 57, 60, 3, 80])}


def passages():
    docs = {}
    for i, item in ITEMS.items():
        docs[10 * i] = sentence(50) + item + sentence(30)
        docs[10 * i + 1] = item
    docs[100] = sentence(200)
    changed = list(ITEMS[3])
    changed[1] = "other"
    docs[101] = sentence(9) + changed + sentence(9)
    docs[102] = sentence(9) + ITEMS[4][:30] + ["added"] + ITEMS[4][30:] + sentence(9)
    docs[103] = sentence(9) + ITEMS[6][:40] + ITEMS[6][41:] + sentence(9)
    docs[104] = ITEMS[3][:40] + sentence(20)
    docs[105] = sentence(5) + ITEMS[0] + ITEMS[1] + ITEMS[0]
    docs[106] = ["The"] * 3 + ITEMS[2] * 40
    return {i: " ".join(words).upper() if i % 2 else "\n".join(words) for i, words in docs.items()}


def similarity(a, b):
    n = min(5, len(b))
    x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
    shared = sum((x & y).values())
    return shared / max(1, sum(x.values()) + sum(y.values()) - shared)


def brute(docs):
    best = {}
    for i, text in docs.items():
        found = text.lower().split()
        for j, item in ITEMS.items():
            starts = range(max(1, len(found) - len(item) + 1)) if len(found) >= min(5, len(item)) else []
            scores = [similarity(found[s : s + len(item)], item) for s in starts]
            # Windows may reach over the end of a document.
            scores += [similarity(found[s:], item) for s in range(max(0, len(found) - len(item)), len(found) - min(5, len(item)) + 1)]
            if scores and max(scores) >= 0.8:
                best[i, j] = round(max(scores), 6)
    return best


@pytest.fixture(scope="module")
def tables(spark):
    docs = passages()
    documents = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").withColumn("start", F.lit(1))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in ITEMS.items()], "item_id bigint, text string")
    return docs, documents, benchmark


@pytest.mark.parametrize("rows", [10**6, 40])
def test_all_passages_are_found(tables, rows):
    docs, documents, benchmark = tables
    found = contaminated(documents, benchmark, DecontaminationParams(broadcast_rows=rows)).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in found} == brute(docs)
    for r in found:
        window = docs[r.doc_id].lower().split()[r.start_word : r.start_word + r.n_words]
        assert abs(similarity(window, ITEMS[r.item_id]) - r.similarity) < 1e-6
        assert r.hamming <= RADIUS


def test_blocks_guarantee_the_radius(spark):
    draw = random.Random(7)
    rows = []
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(0, RADIUS)):
            b ^= 1 << bit
        rows.append((a - (1 << 63), b - (1 << 63)))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint")
    shared = f"size(array_intersect({_block_values('a', True)}, {_block_values('b', False)}))"
    assert pairs.where(f"{shared} = 0").count() == 0


def test_odd_rows(spark, tables):
    _, documents, benchmark = tables
    odd = spark.createDataFrame([(None, " ".join(ITEMS[0])), (7, None), (7, ""), (8, " ".join(ITEMS[0])), (8, " ".join(ITEMS[0]))], "doc_id bigint, text string")
    found = contaminated(odd, benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in found) == [(-1, 0), (8, 0)]
    assert [r.doc_id for r in clean_documents(odd, benchmark).collect()] == [7, 7]
    assert contaminated(documents, benchmark.limit(0)).count() == 0
    assert contaminated(documents.limit(0), benchmark).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, " ")], "item_id bigint, text string")
    assert clean_documents(documents, nothing).count() == documents.count()


def test_rows_that_share_a_key(spark, tables):
    _, _, benchmark = tables
    item, clean = " ".join(ITEMS[3]), " ".join(sentence(90))
    near = " ".join(ITEMS[3][:6] + sentence(60))  # shares shingles with the item at the same start
    rows = [(None, " ".join(ITEMS[0])), (None, clean), (None, None), (8, item), (8, near), (9, near), (9, item)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    found = contaminated(docs, benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.similarity) for r in found) == [(-1, 0, 1.0), (8, 3, 1.0), (9, 3, 1.0)]
    left = {(r.doc_id, r.text) for r in clean_documents(docs, benchmark).collect()}
    assert left == {(None, clean), (None, None), (8, near), (9, near)}
