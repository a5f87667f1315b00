import pytest

from joinseek.operators import semantic
from joinseek.operators.names import similar_columns
from joinseek.operators.profile import profile
from joinseek.operators.semantic import Taxonomy, ancestors, semantic_similarity
from joinseek.plans.discover import pair_table
from joinseek.session import settle

ISA = [("dog", "canine"), ("wolf", "canine"), ("canine", "animal"), ("cat", "feline"), ("feline", "animal"),
       ("dog", "pet"), ("cat", "pet"), ("pet", "animal"), ("animal", "thing"), ("city", "place"), ("place", "thing")]
SENSES = [("dog", "dog"), ("hound", "dog"), ("wolf", "wolf"), ("cat", "cat"), ("City", "city"), ("town", "city"),
          ("jaguar", "cat"), ("jaguar", "city"), ("lonely", "island")]


@pytest.fixture(scope="module")
def taxonomy(spark):
    return Taxonomy(
        spark.createDataFrame(SENSES, "word string, sense string"),
        spark.createDataFrame(ISA, "child string, parent string"),
    )


@pytest.mark.parametrize(
    "first, second, score",
    [
        ("dog", "hound", 1.0),
        ("dog", "wolf", 1 / 3),
        ("dog", "cat", 1 / 3),  # over pet, not over animal
        ("wolf", "cat", 1 / 5),
        ("dog", "town", 1 / 6),
        ("jaguar", "town", 1.0),  # the better of two senses
        ("CITY", "town", 1.0),
        ("dog", "lonely", 0.0),
        ("dog", "unheard", 0.0),
        ("lonely", "lonely", 1.0),
    ],
)
def test_path_similarity(spark, taxonomy, first, second, score):
    pairs = spark.createDataFrame([(first, second)], "first string, second string")
    assert semantic_similarity(pairs, taxonomy).first().score == pytest.approx(score)


def test_deep_chain_and_cycle(spark):
    chain = [(str(i), str(i + 1)) for i in range(20)]
    found = ancestors(spark.createDataFrame(chain, "child string, parent string"))
    assert found.where("sense = '0' AND ancestor = '20'").first().steps == 20
    assert found.count() == 20 * 21 // 2
    cycle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "child string, parent string")
    assert {(r.sense, r.ancestor): r.steps for r in ancestors(cycle).collect()} == {
        ("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2,
    }
    assert ancestors(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_semantic_names(spark, taxonomy):
    tables = {"a": spark.createDataFrame([(1, 2)], ["dog", "zzz"]), "b": spark.createDataFrame([(1, 2)], ["hound", "town"])}
    catalog = settle(profile(tables, distinct=False))
    pairs = pair_table(spark, [("a", "b")])
    found = similar_columns(catalog, pairs, [("Levenshtein", 0.9), ("Semantic", 0.5)], taxonomy).collect()
    assert [(r.left, r.right) for r in found] == [(["dog"], ["hound"])]
    assert [(i.method, i.score) for i in found[0].similarity_info] == [("Semantic", 1.0)]


def test_pairs_of_profiles_climb_once(spark, monkeypatch):
    nations = [(f"n{i}", "world") for i in range(3)]
    senses = [(f"{side}{k}", f"{side}{k}") for side in "cs" for k in range(60)]
    isa = spark.createDataFrame(nations + [(s, f"n{int(s[1:]) % 3}") for _, s in senses], "child string, parent string")
    taxonomy = Taxonomy(spark.createDataFrame(senses, "word string, sense string"), isa)
    rows = [(f"C{i}", f"s{j}") for i in range(60) for j in range(60)] + [(None, "s1"), ("c1", None), ("x", "s2")]
    kept, plain = [], semantic.written

    def counted(df):
        kept.append((df.columns, plain(df)))
        return kept[-1][1]

    monkeypatch.setattr(semantic, "written", counted)
    found = semantic_similarity(spark.createDataFrame(rows * 2, "first string, second string"), taxonomy).collect()
    assert len(found) == len(rows)
    for r in found:
        known = r.first is not None and r.second is not None and r.first != "x"
        path = 2 if known and int(r.first[1:]) % 3 == int(r.second[1:]) % 3 else 4
        assert r.score == pytest.approx(1 / (1 + path) if known else 0), r
    assert [df.count() for columns, df in kept if "__path" in columns] == [9]
