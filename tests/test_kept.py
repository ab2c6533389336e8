"""Totals, bitmaps and text indexes that are kept beside the tables."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import scalars as S
from tracewell.plans import reports as R
from tracewell.plans.textindex import TextIndex, grams_of
from tracewell.plans.totals import SUMS, DailyDistinct, SessionTotals

COLUMNS = "session_id string, created_at timestamp, project_name string, message_count int, total_input_tokens bigint, total_output_tokens bigint, total_cache_read bigint, total_cache_write bigint"


def test_totals_equal_a_full_scan_after_each_batch(spark, tmp_path):
    rng = random.Random(1)
    kept, current = SessionTotals(spark, str(tmp_path)), {}
    for batch in range(3):
        before, after = [], []
        for i in rng.sample(range(60), 25):
            if i in current:
                before.append(current[i])
            day = dt.datetime(2024, 1, 1 + (i % 7 if batch < 2 else 3), 5)
            project = rng.choice(["a", "b", None]) if batch else "a"
            current[i] = (f"s{i}", day, project, *(rng.randrange(100) for _ in range(5)))
            after.append(current[i])
        kept.apply(batch, *(spark.createDataFrame(rows, COLUMNS) for rows in (before, after)))
        if batch == 1:
            kept.apply(batch, *(spark.createDataFrame(rows, COLUMNS) for rows in (before, after)))  # run again
        now = spark.createDataFrame(list(current.values()), COLUMNS)
        sums = [F.count("*").alias("sessions"), *(F.sum(c).alias(n) for n, c in SUMS.items() if c)]
        want = now.groupBy(F.to_date("created_at").alias("day"), "project_name").agg(*sums)
        order = lambda df: sorted(map(tuple, df.select("day", "project_name", *SUMS).collect()), key=repr)
        assert order(kept.table()) == order(want)
        as_of = dt.date(2024, 1, 8)
        names = ["project_name", "sessions", "input_tok", "output_tok", "cache_read", "cache_write", "total"]
        assert kept.tokens_by_project(as_of, 6).select(names).collect() == R.tokens_by_project(now, as_of, 6).select(names).collect()
        assert kept.cost_by_project(as_of).collect() == R.cost_by_project(now, as_of).select(kept.cost_by_project(as_of).columns).collect()
        assert kept.daily_activity(as_of).collect() == R.daily_activity(now, as_of).collect()
    # a session that came back as it was changes no day
    kept.apply(3, spark.createDataFrame([current[0]], COLUMNS) if 0 in current else now.limit(1), spark.createDataFrame([current[0]], COLUMNS) if 0 in current else now.limit(1))
    assert spark.read.parquet(f"{tmp_path}/session_totals/batch_id=3").count() == 0


def test_distinct_sessions_of_any_days(spark, tmp_path):
    rng = random.Random(2)
    kept, rows = DailyDistinct(spark, str(tmp_path)), []
    for batch in range(3):
        own = [(rng.choice("xyz"), f"s{rng.randrange(150)}" if rng.random() < 0.95 else None, dt.datetime(2024, 1, rng.randrange(1, 20), 3)) for _ in range(400)]
        rows += own
        frame = spark.createDataFrame(own, "name string, session_id string, timestamp timestamp")
        kept.apply(batch, frame)
        if batch == 1:
            kept.apply(batch, frame)
    numbers = [r.number for r in kept._numbers().collect()]
    assert sorted(numbers) == list(range(len(numbers)))  # dense, each once
    for first, last in ((None, None), (5, 5), (3, 11), (12, None), (None, 4)):
        days = [dt.date(2024, 1, d) if d else None for d in (first, last)]
        want = []
        for name in "xyz":
            own = [(s, t.date()) for n, s, t in rows if n == name and (not first or t.day >= first) and (not last or t.day <= last)]
            want.append((name, len(own), len({s for s, _ in own} - {None}), min(d for _, d in own), max(d for _, d in own)))
        assert sorted(map(tuple, kept.between(*days).collect())) == want


def test_grams():
    assert grams_of("abcd", False) == {"abc", "bcd"} and grams_of("ab%cde_f", False) == {"cde"} and grams_of("a%c", True) == {"a%c"} and grams_of("ab", True) == set()


@pytest.mark.parametrize("query, literal", [("needle", False), ("NEEDLE", True), ("straße", False), ("n__dle%hay", False), ("of", False), ("e%d", True), ("nowhere at all", False), ("%", False)])
def test_index_finds_what_a_scan_finds(spark, tmp_path, query, literal):
    rng = random.Random(3)
    words = "the of and Straße STRASSE hay stack İstanbul needles Needle e%d x".split()
    rows = [(i, " ".join(rng.choices(words[:3], k=40)) + (" " + rng.choice(words) if i % 40 == 0 else ""), None if i % 3 else "and hay") for i in range(400)]
    rows += [(1000, "one needle in the hay", None), (1001, None, "NEEDLE of stack"), (1002, "", "")]
    df = spark.createDataFrame(rows, "i int, content string, description string")
    index = TextIndex(spark, str(tmp_path / "index")).build(df, "content", "description", shard_bytes=2000)
    match = S.matches(F.col("content"), query, literal) | S.matches(F.col("description"), query, literal)
    found = index.candidates(query, literal)
    assert {r.i for r in found.where(match).collect()} == {r.i for r in df.where(match).collect()}


def test_rare_queries_read_few_files(spark, tmp_path):
    rows = [(i, f"common words everywhere, number {i % 7}" + (" with a zyzzyva" if i == 123 else "")) for i in range(2000)]
    index = TextIndex(spark, str(tmp_path)).build(spark.createDataFrame(rows, "i int, content string"), "content", shard_bytes=4000)
    size = lambda query: sum(os.path.getsize(r.f.removeprefix("file://")) for r in index.candidates(query).select(F.input_file_name().alias("f")).distinct().collect())
    assert 0 < size("zyzzyva") * 10 < size("everywhere") and index.candidates("qqq").count() == 0
    assert index.candidates("zyzzyva").where(F.col("i") == 123).count() == 1


def test_raw_sql_leaves_views_alone(spark):
    spark.range(3).createOrReplaceTempView("sessions")
    try:
        table = spark.range(7).toDF("x")
        assert R.sql(spark, "WITH t AS (SELECT count(*) AS n FROM sessions) SELECT n FROM t;", {"sessions": table}).first().n == 7
        assert spark.table("sessions").count() == 3
        with pytest.raises(Exception, match="(?i)syntax|parse"):
            R.sql(spark, "DROP VIEW sessions", {"sessions": table})
        assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tracewell_")]
    finally:
        spark.catalog.dropTempView("sessions")
