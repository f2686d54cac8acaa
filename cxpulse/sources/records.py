"""CSV files whose quoted fields hold line breaks, read in as many tasks as the file has splits.

Spark's own ``multiLine`` reader gives a whole file to one task.  Here files are read as lines, which Spark splits
anywhere, and a first pass finds out which splits begin inside a quoted field:

1. every split reads its lines with a two-state machine (outside or inside a quoted field) from both states and
   keeps the state each of them ends in, so a split is a function from state to state;
2. the functions of a file's splits, composed in order, give the state every split starts in;
3. the second pass starts each split in its state and cuts it into records.  Records that lie within a split leave it
   whole; only the piece of a record before the first cut and the one after the last cut of a split are grouped, by
   (file, record), and joined in order;
4. `from_csv` parses the records; one that does not fit the schema is returned in the corrupt-record column.

The driver holds three bits a split, less than the list of splits it plans every scan with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

CORRUPT = "_corrupt_record"
_ENDS = "file string, start long, from_outside boolean, from_inside boolean, closes boolean"
_PIECES = "file string, start long, owner long, open boolean, first boolean, record string"


class LineStates:
    """Transitions of the two-state machine over one line (without its line break)."""

    def __init__(self, sep: str = ",", quote: str = '"'):
        if len(sep) != 1 or len(quote) != 1 or sep == quote:
            raise ValueError("separator and quote must be two different characters")
        q = re.escape(quote)
        self.sep, self.quote = sep, quote
        # up to the closing quote; a doubled quote stands for one
        self.close = re.compile(f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}")

    def ends_inside(self, line: str, inside: bool) -> bool:
        """Whether the line's end lies inside a quoted field, given whether its start does.

        A quote opens a field only as its first character; in other places of an unquoted field, or after the closing
        quote, it is a character like any other.
        """
        if self.quote not in line:
            return inside
        at = 0
        while True:
            if inside or line.startswith(self.quote, at):
                closed = self.close.match(line, at if inside else at + 1)
                if closed is None:
                    return True
                at, inside = closed.end(), False
            at = line.find(self.sep, at) + 1
            if not at:
                return False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    # cut at line feeds alone, so that carriage returns inside fields stay
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.col("value").alias("line"))


def _splits(batches) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """((file, start), lines) runs in order; a split of several batches gives several runs."""
    for batch in batches:
        files, starts, lines = (batch.column(i).to_pylist() for i in range(3))
        a = 0
        for b in range(1, len(lines) + 1):
            if b == len(lines) or starts[b] != starts[a] or files[b] != files[a]:
                yield (files[a], starts[a]), lines[a:b]
                a = b


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ENDS_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("from_outside", pa.bool_()),
                         ("from_inside", pa.bool_()), ("closes", pa.bool_())])
_PIECES_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("owner", pa.int64()), ("open", pa.bool_()),
                           ("first", pa.bool_()), ("record", pa.string())])


def _scan_ends(states: LineStates):
    """Each split's states at its end from both states at its start, and whether a field open at its start closes in it."""
    def run(batches):
        ends: dict = {}  # the splits of one task
        for key, lines in _splits(batches):
            outside, inside, closes = ends.get(key, (False, True, False))
            for line in lines:
                same = outside == inside
                outside = states.ends_inside(line, outside)
                inside = outside if same else states.ends_inside(line, inside)
                closes = closes or not inside
            ends[key] = (outside, inside, closes)
        yield _batch([(*k, *v) for k, v in ends.items()], _ENDS_ARROW)
    return run


def open_starts(ends: list[tuple[str, int, bool, bool, bool]]) -> dict[tuple[str, int], int]:
    """For each split that begins inside a quoted field: the start of the split in which that field's record begins.

    The splits' functions are composed in file order.
    """
    owners, file, inside, begun = {}, None, False, 0
    for name, start, from_outside, from_inside, closes in sorted(ends):
        if name != file:
            file, inside = name, False
        if inside:
            owners[(name, start)] = begun
        if not inside or closes:
            begun = start  # a record open at the end begins here
        inside = from_inside if inside else from_outside
    return owners


def _cut(states: LineStates, owners: dict[tuple[str, int], int]):
    """Pieces of records: whole ones, and open ones under the split their record begins in."""
    def run(batches):
        out: list[tuple] = []
        key, held, inside, owner, first = None, [], False, None, False
        for at, lines in _splits(batches):
            if at != key:
                if held:
                    out.append((*key, owner, True, first, "\n".join(held)))
                key, held, owner = at, [], owners.get(at, at[1])
                inside, first = at in owners, at[1] == 0
            begins_inside = owner != key[1]
            for line in lines:
                inside = states.ends_inside(line, inside)
                held.append(line)
                if not inside:
                    out.append((*key, owner, begins_inside, first, "\n".join(held)))
                    held, owner, begins_inside, first = [], key[1], False, False
            if out:
                yield _batch(out, _PIECES_ARROW)
                out = []
        if held:
            yield _batch([(*key, owner, True, first, "\n".join(held))], _PIECES_ARROW)
    return run


def csv_records(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """(file, start, first, record): the records of CSV files as text, quoted line breaks kept.

    ``start``: byte offset of the split the record begins in; ``first``: it is its file's first one.  Empty lines
    outside fields are no records.  A quoted field that a file leaves open reaches to the file's end.
    """
    ship_package(spark)
    states = LineStates(sep, quote)
    lines = _lines(spark, path)
    ends = lines.mapInArrow(_scan_ends(states), _ENDS).collect()  # one row a split
    pieces = lines.mapInArrow(_cut(states, open_starts([tuple(r) for r in ends])), _PIECES)
    whole = pieces.where(~F.col("open")).select("file", "start", "first", "record")
    # at most two pieces a split: a record's pieces are as many as the splits it reaches over
    joined = pieces.where("open").groupBy("file", F.col("owner").alias("start")).agg(
        F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct(F.col("start").alias("at"), "record"))).alias("p"))
    records = whole.unionByName(joined.select("file", "start", "first", F.array_join("p.record", "\n").alias("record")))
    return records.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record != ''")


def read_csv_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str, header: bool = True,
                     sep: str = ",", quote: str = '"', corrupt: str = CORRUPT) -> DataFrame:
    """CSV files with quoted line breaks under an explicit schema, and a column with the text of records that do not fit it.

    With ``header`` the first record of each file is dropped.  Numbers and dates that cannot be read, and records of
    too few or too many fields, are null where unread and come whole in ``corrupt`` (null in good records).
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if corrupt in fields.names:
        raise ValueError(f"the schema has a column {corrupt}")
    records = csv_records(spark, path, sep, quote)
    if header:
        records = records.where(~F.col("first"))
    full = T.StructType([*fields.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_csv("record", full.simpleString(), {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true",
                                                        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    return records.select(parsed.alias("r")).select("r.*")
