"""Input sources: Parquet / CSV scans and input validation.

The engine works on any Spark ``DataFrame`` (a table, a view, a query result
or a scan).  Parquet is the recommended source: date filters and column
pruning reach the scan.  CSV needs an explicit schema (no inference pass over
the data); a list column stored in CSV arrives as text and is parsed by
``prepare`` (``parser="split"`` or ``"json"``).  Files whose fields hold line
breaks are better read by `records.read_csv_records`: ``multi_line`` gives each
file to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

DEFAULT_CSV_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("conversation_id", T.StringType()),
    T.StructField("verbatims", T.StringType()),
])


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str = DEFAULT_CSV_SCHEMA,
             header: bool = True, multi_line: bool = False, **options) -> DataFrame:
    reader = spark.read.schema(schema).option("header", str(header).lower())
    # messages rendered as lists contain commas and quotes: the usual CSV quoting applies
    reader = reader.option("multiLine", str(multi_line).lower()).option("escape", '"')
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_dataframe(df) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(
            f"unsupported input type {type(df)!r}: expected a pyspark.sql.DataFrame "
            "(a table, a view, a query result or a file scan)"
        )
    return df


def require_columns(df: DataFrame, *cols: str | None) -> None:
    missing = [c for c in cols if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; available: {df.columns}")
