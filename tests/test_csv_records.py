"""Multi-line CSV in many splits against Spark's one-task reader and against Python's csv module."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from cxpulse.sources.inputs import table
from cxpulse.sources.records import LineStates, csv_records, open_starts, read_csv_records

SCHEMA = "id long, name string, text string"


@pytest.fixture()
def small_splits(spark):
    """Splits of a few hundred bytes, so that records reach over several of them."""
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def _write(path, rows, header=("id", "name", "text"), newline="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(header)
        w.writerows(rows)


def _rows(rng, n):
    pieces = ['he said "no"', "a,b", "line\nbreak", "\n\n", '""', "plain", "é è 😀", ' " ', "x" * 700, "1\n2\n" * 60, ","]
    return [(i, "n" + rng.choice(["", ",", '"', "\n"]), "t" + "".join(rng.choice(pieces) for _ in range(rng.randrange(4))))
            for i in range(n)]


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_many_splits_equal_the_csv_module(small_splits, tmp_path, seed, newline):
    rng = random.Random(seed)
    want = []
    for k in range(2):
        rows = _rows(rng, 60)
        _write(tmp_path / f"{k}.csv", rows, newline=newline)
        want += rows
    got = read_csv_records(small_splits, str(tmp_path), SCHEMA)
    lines = small_splits.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    got = got.collect()
    assert sorted(_key(r[:3]) for r in got) == sorted(_key(r) for r in want)
    assert all(r[3] is None for r in got)


def test_equals_the_one_task_reader_on_the_turns(small_splits, spark, tmp_path):
    turns = table(spark, SF0001, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws("\n", "role", "text", F.lit('"x", y')).alias("text"))
    path = str(tmp_path / "turns")
    turns.coalesce(2).write.option("header", True).option("escape", '"').csv(path)
    one = spark.read.schema("id string, text string").option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    many = read_csv_records(spark, path, "id string, text string").drop("_corrupt_record")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) == sorted(map(tuple, turns.collect()))


def test_bad_records_come_back_whole(small_splits, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('id,name,text\n1,a,b\nx,a,"two\nlines"\n2,only\n3,a,b,c\n\n4,5" disk,"u"v\n5,"open\nto the end\n')
    got = {r[0] if r[0] is not None else r[3]: r[3] for r in read_csv_records(small_splits, str(path), SCHEMA).collect()}
    assert got['x,a,"two\nlines"'] == 'x,a,"two\nlines"'
    assert got[1] is None and got[4] is None
    assert got[2] == "2,only" and got[3] == "3,a,b,c"
    assert 5 in got and len(got) == 6


def test_empty_and_header_only_files(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,name,text\n")
    assert read_csv_records(small_splits, str(tmp_path), SCHEMA).count() == 0
    (tmp_path / "c.csv").write_text('"id\n' + "x" * 2000 + '\n",name,text\n7,a,b')
    assert [tuple(r)[:3] for r in read_csv_records(small_splits, str(tmp_path), SCHEMA).collect()] == [(7, "a", "b")]
    assert csv_records(small_splits, str(tmp_path)).where("first").count() == 2


def test_states_of_a_line():
    s = LineStates()
    assert not s.ends_inside('a,"b",c', False) and s.ends_inside('a,"b', False)
    assert not s.ends_inside('5" disk,x', False) and s.ends_inside("plain", True)
    assert not s.ends_inside('b"" c",d', True) and s.ends_inside('b",""",d', True)
    with pytest.raises(ValueError):
        LineStates('"', '"')


def test_split_functions_are_composed_in_order():
    # outside -> inside (open), stays inside without a close, closes and opens again, closes
    ends = [("f", 0, True, True, False), ("f", 10, True, True, False), ("f", 20, False, True, True), ("f", 30, True, False, True),
            ("g", 0, False, True, False), ("g", 10, False, True, False)]
    random.Random(1).shuffle(ends)
    assert open_starts(ends) == {("f", 10): 0, ("f", 20): 0, ("f", 30): 20}


def test_states_agree_with_the_csv_module():
    rng = random.Random(3)
    for _ in range(300):
        buffer = io.StringIO()
        rows = [["".join(rng.choice('a",\n') for _ in range(rng.randrange(6))) for _ in range(3)] for _ in range(3)]
        csv.writer(buffer, lineterminator="\n").writerows(rows)
        s, inside, records = LineStates(), False, 0
        for line in buffer.getvalue().split("\n")[:-1]:
            inside = s.ends_inside(line, inside)
            records += not inside
        assert records == 3 and not inside
