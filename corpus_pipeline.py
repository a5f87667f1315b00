"""From raw documents to a training mix, in five stages.

Each stage is a function of (spark, docs, folder) and returns a DataFrame, which
is written as Parquet to the shared folder and read again for the next one. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joinseek.llm import decontamination, mixing, near_duplicates, pii, quality
from joinseek.llm.queries import MIX, table, trusted_documents
from joinseek.llm.text import kept_table


def keep_good(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    judged = quality.judged(docs, trusted_documents(spark, folder))
    return judged.where("kept").select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, folder, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text."""
    redacted = pii.redact(docs)
    return redacted.selectExpr(*("CAST(length(text) AS BIGINT) AS n_chars" if c == "n_chars" else c for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A row per chosen copy, with its epoch and the words that the budget pays for."""
    return mixing.mixed(docs, MIX)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_copy),
    ("benchmark decontamination", drop_benchmark),
    ("personal data", redact_pii),
    ("source mix", mix),
]

#: The first stage scores by hashes that SQL engines do not share.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
