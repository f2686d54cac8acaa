"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: the ASCII white space every word and normalisation rule of this package refers to
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def setup(spark: SparkSession) -> SparkSession:
    """Session settings of this package: the package itself on the executors, small Arrow batches (texts can be long)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder (removed with the DataFrame where the cluster cleans checkpoints)."""
    return materialize(df)


def word_count(col: str) -> Column:
    """Number of maximal runs without ASCII white space (null: 0)."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
