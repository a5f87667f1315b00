"""Session helpers: naming columns, cutting lineage, small driver-made tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column name as SQL text, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string as an SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def column(name: str) -> Column:
    """The column of exactly this name."""
    return F.col(quoted(name))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for written intermediate data.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="joinseek-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs in here delete their shuffle files as they end, not when the driver's memory is next cleaned.

    For results that are kept elsewhere: of a chain of such steps only the one that
    runs takes disk.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, True)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the checkpoint folder.

    For rows about pairs of columns, whose number is a product of the widths of
    two tables: they stay off the driver, and later plans see their size.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    """A DataFrame over schema facts the driver already holds (names, ids)."""
    arrays = [pa.array(columns[name], type=types[name]) for name in types]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(types)))


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` and keep its rows as a local relation.

    Only for rows about single columns, keys and table pairs, whose number depends
    on the schemas and not on the data. The driver must read the column names in
    them anyway to build the next scan; later plans then see their exact size and
    do not run the scans behind them again. Candidates and reports are ``written``.
    """
    with freed_shuffles(df.sparkSession):
        # A plan of its own, lest a later job of ``df`` look for the files.
        rows = df.select("*").toArrow()
    return df.sparkSession.createDataFrame(rows)
