"""Landing zone ingest and windowed reports on streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import rec
from tracewell.plans.warehouse import Warehouse
from tracewell.streaming import landing, rollups


def run(spark, tree, tmp_path, **kw):
    query = landing.start_landing(spark, f"{tree.root}/in", str(tmp_path / "out"), str(tmp_path / "ck"), **kw)
    query.awaitTermination()
    assert query.exception() is None
    return Warehouse(spark, str(tmp_path / "out"))


def test_landing_zone(spark, tree, tmp_path):
    tree.jsonl("in/p/A.jsonl", [rec("1", "hi", type="user", sessionId="A"), rec("2", sessionId="A"), rec("1", sessionId="A", tokens=(9,))])
    tree.jsonl("in/p/bad.jsonl", [rec("1"), "[1]"])
    archive = str(tmp_path / "archive")
    wh = run(spark, tree, tmp_path, archive=archive)
    assert {r.uuid: r.input_tokens for r in wh.table("messages").collect()} == {"1": 9, "2": 0}
    assert wh.table("sessions").first().first_prompt == "hi"
    assert wh.log("_rejects").first().reason == "not an object"
    assert wh.state["landing"].files_synced == 1
    # a batch that comes again after its commit changes nothing
    lines = spark.range(0).selectExpr("'x' file_path", "0L mtime_ms", "0L file_size", "0L block_start", "'' value")
    landing.load_batch(lines, 0, str(tmp_path / "out"))
    assert Warehouse(spark, str(tmp_path / "out")).batch == wh.batch
    # compaction in between does not disturb the stream's own count
    wh.compact()
    tree.jsonl("in/p/B.jsonl", [rec("1", sessionId="B")], 1_700_000_100)
    wh = run(spark, tree, tmp_path, archive=archive)
    assert {r.session_id for r in wh.table("sessions").collect()} == {"A", "B"}
    assert wh.state["landing"].files_synced == 2


def drained(spark, tmp_path, rollup, batches, ddl):
    """The report after each batch; every batch is a new run of the same query."""
    folder = str(tmp_path / "rows")
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, ddl).withColumn("timestamp", F.col("t").cast("timestamp"))
        frame.drop("t").coalesce(1).write.parquet(f"{folder}/step={i}")
        stream = spark.readStream.schema(frame.drop("t").schema).parquet(f"{folder}/step=*")
        query = rollups.start_rollup(stream, str(tmp_path / "out"), str(tmp_path / "ck"), rollup)
        query.awaitTermination()
        assert query.exception() is None
        yield sorted((tuple(r) for r in rollups.report_of(spark, str(tmp_path / "out")).collect()), key=lambda r: r[0])


def test_weeks_begin_on_monday_and_late_rows_count(spark, tmp_path):
    first = [("2024-01-07 23:59:59", "Edit"), ("2024-01-08 00:00:00", "Read"), ("2024-01-09 00:00:00", "Edit"), (None, "Edit")]
    second = [("2024-01-01 00:00:00", "Edit"), ("2024-01-20 00:00:00", "Read")]
    third = [("2024-01-01 00:00:00", "Read"), ("2024-01-20 00:00:00", "Grep")]
    day = dt.date(2024, 1, 1)
    steps = list(drained(spark, tmp_path, rollups.weekly_write_read(), [first, second, third], "t string, tool_name string"))
    assert steps[0] == [(day, 1, 0, None, 0), (dt.date(2024, 1, 8), 1, 1, 1.0, 0)]
    assert steps[1] == [(day, 2, 0, None, 1), (dt.date(2024, 1, 8), 1, 1, 1.0, 0), (dt.date(2024, 1, 15), 0, 1, 0.0, 0)]
    assert steps[2] == [(day, 2, 1, 2.0, 2), (dt.date(2024, 1, 8), 1, 1, 1.0, 0), (dt.date(2024, 1, 15), 0, 1, 0.0, 0)]


def test_distinct_sessions_are_exact_over_batches(spark, tmp_path):
    batches = [[(f"2024-01-0{1 + i % 2} 10:00:00", 1, 2, f"s{i % n}") for i in range(3 * n)] for n in (50, 80, 7)]
    *_, last = drained(spark, tmp_path, rollups.daily_messages(), batches, "t string, input_tokens long, output_tokens long, session_id string")
    rows = [r for b in batches for r in b]
    for day, messages, tok_in, tok_out, sessions, late in last:
        own = [r for r in rows if r[0].startswith(day.isoformat())]
        assert (messages, tok_in, tok_out, sessions, late) == (len(own), len(own), 2 * len(own), len({r[3] for r in own}), 0)


def test_a_batch_that_runs_again_replaces_its_own(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1, 2, "s")], "t string, input_tokens long, output_tokens long, session_id string")
    rows, out = rows.withColumn("timestamp", F.col("t").cast("timestamp")), str(tmp_path / "out")
    for batch in (0, 1, 1, 0):
        rollups.add_batch(rows, batch, out, rollups.daily_messages())
    rollups.add_batch(rows.limit(0), 2, out, rollups.daily_messages())
    assert [r.asDict()["messages"] for r in rollups.report_of(spark, out).collect()] == [1]
    rollups.add_batch(rows, 1, out, rollups.daily_messages())
    assert [tuple(r) for r in rollups.report_of(spark, out).collect()] == [(dt.date(2024, 1, 1), 2, 2, 4, 1, 0)]
