"""Write a report (dict of DataFrames) to any Spark file sink.

Each frame goes to ``{path}/{name}``.  Parquet and JSON keep nested columns
(``top_negative_terms``, ``sample_verbatims``, ``top_words``); CSV cannot, so
array / struct columns are rendered as JSON text for that format.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_for_csv(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_frame(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, **options) -> None:
    if fmt == "csv":
        df = flatten_for_csv(df)
        options.setdefault("header", "true")
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(path)


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite",
                 **options) -> list[str]:
    """Write every frame of ``report``; returns the written names."""
    written = []
    for name, df in report.items():
        write_frame(df, f"{path.rstrip('/')}/{name}", fmt, mode, **options)
        written.append(name)
    return written


def write_partitions(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> None:
    """Replace the partitions that ``df`` has rows for and leave the others (a rerun of one day replaces that day).

    Rows are first brought together by partition, so that each gets few files.  Rebalancing splits a partition that
    is much larger than the others.  An empty ``df`` changes nothing.
    """
    df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, name: str, by: list[str], buckets: int, sort_by: list[str] | None = None) -> None:
    """A table in the session's warehouse, bucketed and sorted by ``by``: joins, windows and counts over these columns need
    no shuffle of it."""
    df = df.repartition(buckets, *by)
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *by).sortBy(*(sort_by or by)).saveAsTable(name)
