"""SQL functions, observed row counts, partition overwrite and bucketed tables."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import SF0001
from cxpulse.functions.lexicon import Lexicon
from cxpulse.functions.scoring import neg_score
from cxpulse.functions.sql import literal, register_functions
from cxpulse.functions.text import clean_text, letter_runs, parse_list_split
from cxpulse.operators.prepare import prepare, row_counts
from cxpulse.plans import catalog as C
from cxpulse.plans.report import full_report
from cxpulse.plans.sinks import write_bucketed, write_partitions

TEXTS = ["C'est  NUL ! http://x.y/z arnaque", "['a, b', \"c\"]", " [ 'x' , 'é\\n' ] ", "[]", "", None, "œuvre-là   d'accord",
         "scandaleux " * 3000, "a\\'b\tc", "[['x'], 'y']"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sql_functions_equal_the_columns(spark):
    assert "neg_score" in register_functions(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    col = df.select("id", clean_text("t").alias("c"), letter_runs(clean_text("t")).alias("r"), parse_list_split("t").alias("m"),
                    neg_score(clean_text("t")).alias("s"))
    sql = spark.sql("SELECT id, clean_text(t) c, letter_runs(clean_text(t)) r, messages(t) m, neg_score(clean_text(t)) s FROM {d}", d=df)
    assert sorted(map(tuple, col.collect()), key=str) == sorted(map(tuple, sql.collect()), key=str)
    assert "Python" not in plan(sql)
    rows = spark.sql("SELECT d.id, m.pos, m.message FROM {d} d, LATERAL message_rows(d.t) m", d=df).collect()
    assert sorted(map(tuple, rows)) == sorted((r.id, i, m) for r in col.collect() for i, m in enumerate(r.m or []))
    with pytest.raises(ValueError):
        register_functions(spark, Lexicon(words=("l'eau",), bigrams=(), threshold=0.1))


def test_sql_filters_reach_the_scan(spark):
    register_functions(spark)
    docs = spark.read.parquet(SF0001 + "/documents.parquet")
    p = plan(spark.sql("SELECT clean_text(text) c FROM {d} WHERE doc_id = 3", d=docs))
    assert "EqualTo(doc_id,3)" in p and "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_literal_keeps_any_text(spark):
    text = "it's \"q\" \\n \n é \U0001f600 ${x}"
    assert spark.sql("SELECT " + literal(text)).first()[0] == text


def test_row_counts_say_why_rows_go(spark):
    rows = [("2024-01-05", "1", "bonjour"), ("2024-01-07", "2", "encore là"), (None, "3", "sans date"), ("demain", "4", "bonjour"),
            ("2024-01-01", "5", "ok"), ("2024-01-02", "6", None), ("", "7", None), (None, "8", "")]
    df = spark.createDataFrame(rows, "day string, id string, t string")
    seen = Observation()
    out = prepare(df, "day", "t", "id", "text", seen)
    assert out.columns == prepare(df, "day", "t", "id", "text").columns
    assert sorted(r.conversation_id for r in out.collect()) == ["1", "2"]
    assert tuple(row_counts(spark, seen).first()) == (8, 2, 2, 2, 2, dt.date(2024, 1, 5), dt.date(2024, 1, 7))
    seen = Observation()
    prepare(df.drop("day"), None, "t", "id", "text", seen).collect()
    assert tuple(row_counts(spark, seen).first()) == (8, 0, 0, 4, 4, None, None)


def test_row_counts_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "day string, id string, t string").write.parquet(str(tmp_path / "none"))
    seen = Observation()
    assert prepare(spark.read.parquet(str(tmp_path / "none")), "day", "t", "id", "text", seen).collect() == []
    assert tuple(row_counts(spark, seen).first()) == (0, 0, 0, 0, 0, None, None)


def test_report_counts_its_rows(spark):
    conv = C.fixture(spark, SF0001)
    with full_report(conv, with_topics=False, with_examples=False) as rep:
        got = rep.row_counts.first()
        bounds = rep["daily_stats"].agg(F.min("date"), F.max("date"), F.sum("total_conversations")).first()
        assert got.n_rows == conv.count() and (got.min_date, got.max_date, got.n_kept) == tuple(bounds)


def test_a_rerun_of_one_day_replaces_one_partition(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = spark.createDataFrame([(dt.date(2024, 1, d), i) for d in (1, 2, 3) for i in range(4)], "date date, n long")
    write_partitions(rows, path, ["date"])
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=")}
    write_partitions(spark.createDataFrame([(dt.date(2024, 1, 2), 99)], "date date, n long"), path, ["date"])
    write_partitions(rows.limit(0), path, ["date"])
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("date=")}
    assert {d for d in before if before[d] != after[d]} == {"date=2024-01-02"} and before.keys() == after.keys()
    got = sorted((r.date.day, r.n) for r in spark.read.parquet(path).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 99), (3, 0), (3, 1), (3, 2), (3, 3)]


def test_bucketed_tables_join_and_rank_without_a_shuffle(spark):
    a, b = (f"b{uuid.uuid4().hex[:8]}" for _ in range(2))
    rows = spark.range(500).select((F.col("id") % 60).cast("string").alias("conversation_id"), "id")
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.sources.bucketing.autoBucketedScan.enabled"]
    old = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "-1")
        write_bucketed(rows, a, ["conversation_id"], 4)
        write_bucketed(rows.withColumnRenamed("id", "other"), b, ["conversation_id"], 4, ["conversation_id", "other"])
        joined = spark.table(a).join(spark.table(b), "conversation_id")
        counted = spark.table(a).groupBy("conversation_id").count()
        ranked = spark.sql(f"SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) rn FROM {a}")
        for df in (joined, counted, ranked):
            assert "Exchange" not in plan(df)
        want = {}
        for i in range(500):
            want[str(i % 60)] = want.get(str(i % 60), 0) + 1
        assert {r.conversation_id: r["count"] for r in counted.collect()} == want
        assert joined.count() == sum(n * n for n in want.values())
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
        for t in (a, b):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
