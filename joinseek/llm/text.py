"""Words of a text as Spark columns, and small tables kept in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinseek.session import checkpoint_folder, quoted

SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than blank, tab, line feed to carriage return.

    A null or blank text has no words.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    This cuts the lineage without losing data with an executor, and the size of
    the files tells Spark whether a later join may broadcast the table.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the named columns behind a generator of one row.

    Spark pushes a filter on a column through every projection and so would
    evaluate a long chain of array functions again inside one another; it pushes
    nothing through a generator.
    """
    fields = ", ".join(f"'{name}', {quoted(name)}" for name in columns)
    rest = [quoted(c) for c in df.columns if c not in columns]
    made = df.selectExpr(*rest, f"inline(array(named_struct({fields})))")
    return made.select(*(quoted(c) for c in df.columns))
