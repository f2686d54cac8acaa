"""``prepare``: normalise a conversation table and add the cleaned text.

Output schema (canonical names, whatever the input names were)::

    <other input columns>, date date, conversation_id string,
    verbatim_list array<string>, verbatim string, n_messages int, clean string

Rows whose cleaned text has 2 characters or fewer, or whose date is missing
or unparseable, are dropped.  Everything is a projection + filter: no shuffle,
no Python, and the date predicate of later operators still reaches the scan
when ``date`` is a stored column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literal import parse_list_literal
from ..functions.text import PARSERS as NATIVE_PARSERS
from ..functions.text import clean_text, compose_accents
from ..session import ship_package
from ..sources.inputs import ensure_dataframe, require_columns

#: list texts -> messages; "literal" reads all of Python's literals in Arrow batches, the others are native expressions
PARSERS = {**NATIVE_PARSERS, "literal": parse_list_literal}
CANONICAL = ("date", "conversation_id", "verbatim_list", "verbatim", "n_messages", "clean")


def quoted(name: str) -> Column:
    """A column by its exact name (dots and back ticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def message_list(df: DataFrame, col: str, parser: str = "split") -> Column:
    """Dispatch on the column type: text -> parse, array -> as is, scalar -> [text]."""
    dtype = df.schema[col].dataType
    c = quoted(col)
    if isinstance(dtype, T.StringType):
        if parser not in PARSERS:
            raise ValueError(f"parser must be one of {sorted(PARSERS)}")
        return PARSERS[parser](c)
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StringType):
            return c
        return F.transform(c, lambda x: x.cast("string"))
    return F.when(c.isNotNull(), F.array(c.cast("string")))


def to_date(df: DataFrame, col: str) -> Column:
    dtype = df.schema[col].dataType
    c = quoted(col)
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, T.StringType):
        # ISO dates, optionally followed by a time part; anything else -> null -> dropped
        return c.try_cast("date")
    return c.cast("date")


def prepare(df: DataFrame, date_col: str | None = "date", verbatim_col: str = "verbatims",
            conversation_id_col: str = "conversation_id", parser: str = "split",
            observation: Observation | None = None, compose: bool = False) -> DataFrame:
    """Parse the message list, join it with ". ", clean it and filter short texts.

    ``date_col=None`` is accepted for undated tables (no ``date`` column is produced).
    Input columns that would collide with a produced one are refused: rename them first.
    With ``compose``, letters and the combining marks after them are composed before cleaning (`text.compose_accents`).
    With an ``observation``, the first action on the result also counts the rows read and those dropped (`row_counts`).
    """
    df = ensure_dataframe(df)
    require_columns(df, date_col, verbatim_col, conversation_id_col)
    used = {c for c in (date_col, verbatim_col, conversation_id_col) if c}
    clash = [c for c in df.columns if c not in used and c in CANONICAL]
    if clash:
        raise ValueError(f"input column(s) {clash} have the name of a produced column: rename or drop them")
    keep = [quoted(c) for c in df.columns if c not in used]
    cols = list(keep)
    if date_col:
        cols.append(to_date(df, date_col).alias("date"))
        if observation is not None:
            cols.append(quoted(date_col).isNull().alias(_NO_DATE))
    cols.append(quoted(conversation_id_col).cast("string").alias("conversation_id"))
    cols.append(message_list(df, verbatim_col, parser).alias("verbatim_list"))
    out = df.select(*cols).withColumns({
        "verbatim": F.array_join("verbatim_list", ". "),
        "n_messages": F.size("verbatim_list"),
    })
    if compose:
        ship_package(df.sparkSession)
        out = out.withColumn("verbatim", compose_accents("verbatim"))
    # The length filter below refers to `clean`; a plain projection would let
    # the optimizer inline the three-regex chain into the pushed-down filter
    # and evaluate it twice per row.  A one-element generator is a barrier the
    # filter cannot cross, so the chain runs once (about 2.5x faster).
    out = out.select("*", F.explode(F.array(clean_text("verbatim"))).alias("clean"))
    cond = F.length("clean") > 2
    if date_col:
        cond = cond & F.col("date").isNotNull()
    if observation is not None:
        out = out.observe(observation, *_observed(cond, date_col)).drop(_NO_DATE)
    return out.where(cond)


def _observed(kept: Column, date_col: str | None) -> list[Column]:
    """One metric a column of `ROW_COUNTS`; a row is counted under the first reason that drops it."""
    dated = F.col("date").isNotNull() if date_col else F.lit(True)
    missing = F.col(_NO_DATE) if date_col else F.lit(False)
    day = F.col("date") if date_col else F.lit(None).cast("date")
    return [F.count(F.lit(1)).alias("n_rows"), F.count_if(missing).alias("null_date"),
            F.count_if(~dated & ~missing).alias("bad_date"),
            F.count_if(dated & ~F.coalesce(F.length("clean") > 2, F.lit(False))).alias("short_text"),
            F.count_if(F.coalesce(kept, F.lit(False))).alias("n_kept"),
            F.min(F.when(kept, day)).alias("min_date"), F.max(F.when(kept, day)).alias("max_date")]


ROW_COUNTS = "n_rows long, null_date long, bad_date long, short_text long, n_kept long, min_date date, max_date date"
_NO_DATE = "_cxpulse_no_date"


def row_counts(spark, observation: Observation) -> DataFrame:
    """One row: rows read, dropped for a missing date, an unreadable date or a short text, kept, and the kept dates' bounds.

    Call it after an action on the observed table (it waits for one).  The counts are taken while that action's tasks
    read the rows, without a job of their own.
    """
    got = observation.get
    names = [c.split()[0] for c in ROW_COUNTS.split(", ")]
    return spark.createDataFrame([tuple(got.get(n, None if n.endswith("_date") and n[:3] in ("min", "max") else 0) for n in names)],
                                 ROW_COUNTS)


@dataclass(frozen=True)
class DateBounds:
    min_date: object
    max_date: object
    n_rows: int


def date_bounds_df(prepared: DataFrame) -> DataFrame:
    """min(date), max(date), count(*) in one aggregation (partial + final)."""
    return prepared.agg(
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def date_bounds(prepared: DataFrame) -> DateBounds:
    """The three scalars later operators anchor on (one small job)."""
    row = date_bounds_df(prepared).first()
    return DateBounds(row["min_date"], row["max_date"], int(row["n_rows"]))
