"""Registered queries against DuckDB SQL, and the pipeline against its parts."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from joinseek.llm import decontamination, near_duplicates, pii, quality
from joinseek.llm.oracles import ORACLES
from joinseek.llm.queries import QUERIES, table, trusted_documents
from joinseek.llm.text import kept_table

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not there")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    rows = [tuple(r) for r in found.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))


def test_pipeline_equals_its_decisions(spark):
    docs = table(spark, FOLDER, "documents")
    texts = {r.doc_id: r for r in docs.collect()}
    good = {r.doc_id for r in quality.judged(docs, trusted_documents(spark, FOLDER)).where("kept").collect()}
    rest = docs.where(docs.doc_id.isin(*good))
    groups = near_duplicates.near_duplicates(rest).collect()
    single = {r.doc_id for r in groups if r.doc_id == r.component_id}
    found = decontamination.contaminated(rest, table(spark, FOLDER, "benchmark")).collect()
    left = single - {r.doc_id for r in found}
    redacted = {r.doc_id: r.text for r in pii.redact(rest).collect()}

    now = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], [good, single, left, left], strict=True):
        now = kept_table(stage(spark, now, FOLDER), "stage")
        assert now.columns == docs.columns
        assert sorted(r.doc_id for r in now.select("doc_id").collect()) == sorted(want)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and {r.doc_id for r in out} <= left
    for r in out:
        assert r.text == redacted[r.doc_id] and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (texts[r.doc_id].lang, texts[r.doc_id].source)
        assert 0 <= r.n_taken <= len(r.text.split())
