"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinseek.llm import (
    decontamination,
    html_text,
    line_dedup,
    mixing,
    near_duplicates,
    pii,
    prefix_trie,
    quality,
    repeated_lines,
    structure_repair,
    toxicity,
    url_filters,
    warc,
)
from joinseek.session import checkpoint_folder

#: The sources of the test tables have no domain; their numbers stand in for it.
MIX = mixing.MixParams(
    weights={
        "domain": {"web": 0.6, "books": 0.25, "code": 0.15},
        "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    },
    domain_rule="CASE WHEN source RLIKE '^src[0-9]$' THEN 'web' WHEN source RLIKE '^src1[0-4]$' THEN 'books' ELSE 'code' END",
    budget=0.5,
    max_epochs=3,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.selection(table(spark, folder, "documents"), MIX)


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages' own hosts, as no list is given.

    A digest of the host decides: half of the hosts are listed, half of those are
    taken off again and some of these listed once more; parents of some hosts are
    listed from a later day on, and a few paths are allowed.
    """
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    drawn = hosts.selectExpr("host", "md5(host) AS h", "substring_index(host, '.', -2) AS parent")
    drawn = drawn.selectExpr(
        "host", "parent", "substring(h, 1, 1) AS a", "CAST(conv(substring(h, 2, 2), 16, 10) AS INT) AS n", "md5(parent) AS p"
    )
    day = "date_add(DATE '2024-01-01', {})"
    entries = [
        ("host", "'block'", "a < '8'", "n"),
        ("host", "'remove'", "a < '4'", "n + 40"),
        ("host", "'block'", "a < '2'", "n + 90"),
        ("concat(host, '/en')", "'allow'", "a < '6'", "CAST(n DIV 2 AS INT)"),
        ("parent", "'block'", "substring(p, 1, 1) < '4'", "CAST(200 + conv(substring(p, 2, 2), 16, 10) DIV 2 AS INT)"),
    ]
    rows = [
        f"named_struct('pattern', {pattern}, 'action', {action}, 'wanted', {wanted}, 'listed_on', {day.format(at)})"
        for pattern, action, wanted, at in entries
    ]
    listed = drawn.selectExpr(f"inline(array({', '.join(rows)}))").where("wanted").distinct()
    return listed.selectExpr("'derived' AS list", "pattern", "action", "listed_on")


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    fetched = F.expr("date_add(DATE '2024-01-01', CAST(pmod(page_id * 37, 365) AS INT))").alias("fetched_on")
    captures = pages.select("page_id", "url", fetched)
    return url_filters.screened(captures, list_entries(pages))


def find_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(pii.count_of("spans", kind).alias(f"n_{kind}") for kind in pii.BASE),
        F.sha2(pii.span_list("spans", base_only=True), 256).alias("base_sha256"),
        pii.span_list("spans").alias("spans"),
    )


def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = table(spark, folder, "pages")
    warc.write_archive(pages, archive)
    key_type = pages.schema["page_id"].dataType.simpleString()
    return warc.read_archive(spark, archive).select(
        F.col("page").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(f"CAST(nullif(refers_to, '') AS {key_type}) AS refers_to"),
        "verified",
    )


def decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def score_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, folder, "labels")))


def trusted_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality = 1").select("doc_id")


def judge_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    judged = quality.judged(documents, trusted_documents(spark, folder))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "score")


def find_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def cut_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeated_lines.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    spans = F.expr("array_join(transform(removed, x -> concat_ws(':', x.start, x.stop, x.kept_in)), ',')")
    return cut.select("doc_id", "text", F.size("removed").alias("n_removed"), spans.alias("removed"))


def repair_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return structure_repair.repaired_conversations(table(spark, folder, "conversations"))


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def drop_shared_lines(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mix_sources,
    "op2_url_filter": url_filter,
    "op3_pii": find_pii,
    "op4_warc_archive": warc_archive,
    "op5_decontaminate": decontaminate,
    "op6_page_text": page_text,
    "op7_toxicity": score_toxicity,
    "op8_quality": judge_quality,
    "op9_near_duplicates": find_near_duplicates,
    "op10_repeated_lines": cut_repeated_lines,
    "op11_conversation_repair": repair_conversations,
    "op12_conversation_trie": conversation_trie,
    "op13_shared_lines": drop_shared_lines,
}
