"""Reading tables and writing reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinseek.operators.overlap import listing
from joinseek.session import column

# The spellings that count as a missing value in a CSV file.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?[iI]nf(inity)?\s*$"
TRUTH = r"^(True|TRUE|true|False|FALSE|false)$"


def _number(value: Column) -> Column:
    spelled = F.regexp_replace(F.trim(value), "(?i)inf(inity)?$", "Infinity")
    return spelled.try_cast("double")


def has_open_quote(spark: SparkSession, path: str) -> bool:
    """True if a line has an odd number of quotes.

    Without such a line no field goes on to the next line.
    """
    quotes = "length(value) - length(replace(value, '\"', ''))"
    return not spark.read.text(path).where(f"({quotes}) % 2 = 1").isEmpty()


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    multiline: bool | None = None,
    na_values: Sequence[str] = NA_VALUES,
) -> DataFrame:
    """A CSV file with a header; types come from all its values.

    A column is whole, fractional or boolean if every present value is; a boolean
    column with missing values stays a string, a column without values is
    fractional. Quotes are doubled inside quoted fields and leading blanks stay.

    Spark can split a large file only if no field holds a line break, which is
    looked up unless ``multiline`` says so. A given ``schema`` saves the pass over
    the values.
    """
    if multiline is None:
        multiline = has_open_quote(spark, path)
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multiline, inferSchema=False)
    if schema is not None:
        return nan_to_null(reader.schema(schema).csv(path))
    raw = reader.csv(path)
    text = raw.select(*(F.when(~column(c).isin(*na_values), column(c)).alias(c) for c in raw.columns))
    if not text.columns:
        return text
    tests = []
    for i, name in enumerate(text.columns):
        value = column(name)
        whole = F.rlike(value, F.lit(WHOLE)) & value.try_cast("bigint").isNotNull()
        tests += [
            F.every(whole).alias(f"whole{i}"),
            F.every(F.rlike(value, F.lit(NUMBER))).alias(f"number{i}"),
            F.every(F.coalesce(F.rlike(value, F.lit(TRUTH)), F.lit(False))).alias(f"truth{i}"),
        ]
    kinds = text.agg(*tests).first()
    typed = []
    for i, name in enumerate(text.columns):
        value = column(name)
        if kinds[f"number{i}"] is None:
            value = F.lit(None).cast("double")
        elif kinds[f"whole{i}"]:
            value = value.try_cast("bigint")
        elif kinds[f"number{i}"]:
            value = _number(value)
        elif kinds[f"truth{i}"]:
            value = F.lower(value).try_cast("boolean")
        typed.append(value.alias(name))
    return text.select(*typed)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as it is, so that filters on any column reach the scan.

    NaN is told from values where that matters: in profiles, keys, joins, modes.
    """
    return spark.read.parquet(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value, like null."""
    fields = []
    for field in df.schema.fields:
        value = column(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        fields.append(value.alias(field.name))
    return df.select(*fields)


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a report; as ``text`` or ``csv`` it is the listing, one line each."""
    if fmt == "text":
        listing(report).select("line").write.mode("errorifexists").text(path)
    elif fmt == "csv":
        listing(report).write.mode("errorifexists").csv(path, header=True)
    else:
        report.write.mode("errorifexists").format(fmt).save(path)
