"""Golden cases of the reports that the derived data does not reach."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import ParseException

from tracewell.plans import insights as I
from tracewell.plans import reports as R

AS_OF = dt.date(2024, 1, 31)
COLUMNS = (
    "session_id string, project_name string, created_at timestamp, message_count int, total_input_tokens bigint,"
    " total_output_tokens bigint, total_cache_read bigint, total_cache_write bigint, first_prompt string"
)


def ts(text):
    return dt.datetime.fromisoformat(text)


def sessions(spark, *rows):
    full = [
        (
            r.get("id", f"s{i}"), r.get("project", "p"), ts(r["at"]) if r.get("at") else None, r.get("n", 1), r.get("inp", 0),
            r.get("out", 0), r.get("cache", 0), 0, r.get("prompt"),
        )
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, COLUMNS)


def calls(spark, *rows):
    return spark.createDataFrame(
        [(s, t, ts(at) if at else None) for s, t, at in rows], "session_id string, tool_name string, timestamp timestamp"
    )


def test_window_edges(spark):
    s = sessions(
        spark, {"at": "2024-01-24 00:00:00"}, {"at": "2024-01-23 23:59:59"}, {"at": "2024-02-05 00:00:00"}, {"at": None}
    )
    assert R.tokens_by_project(s, AS_OF).first().sessions == 2
    assert R.daily_activity(s, AS_OF, days=14).count() == 3


def test_nulls_sort_last_and_keys_break_ties(spark):
    s = sessions(spark, {"at": None, "id": "a"}, {"at": "2024-01-02 00:00:00", "id": "c"}, {"at": "2024-01-02 00:00:00", "id": "b"})
    assert [r.id for r in R.recent_sessions(s).collect()] == ["b", "c", "a"]
    assert R.marathon(s).first().date == dt.date(2024, 1, 2) or R.marathon(s).count() == 1
    t = calls(spark, ("s", "B", None), ("s", "A", None), ("s", None, None))
    assert [r.tool_name for r in R.favourite_tools(t).collect()] == ["A", "B", None]


def test_overview_of_nothing_has_two_rows(spark):
    o = R.overview(sessions(spark).limit(0), AS_OF)
    assert [(r.period, r.sessions, r.messages, r.avg_msgs, r.projects, r.est_cost_usd) for r in o.collect()] == [
        ("last_30d", 0, None, None, 0, None), ("prev_30d", 0, None, None, 0, None),
    ]
    assert tuple(R.overview_delta(o).first()) == (None,) * 5


def test_overview_periods_and_delta(spark):
    s = sessions(
        spark, {"at": "2024-01-01 00:00:00", "n": 3, "inp": 1_000_000}, {"at": "2023-12-31 23:59:59", "n": 2, "inp": 2_000_000},
        {"at": "2023-12-02 00:00:00", "n": 1, "project": None}, {"at": "2023-12-01 23:59:59", "n": 100},
    )
    o = R.overview(s, AS_OF)
    cur, prev = o.collect()
    assert (cur.sessions, cur.messages, cur.projects, cur.est_cost_usd) == (1, 3, 1, 3.0)
    assert (prev.sessions, prev.messages, prev.projects, prev.avg_msgs, prev.est_cost_usd) == (2, 3, 1, 1.5, 6.0)
    assert tuple(R.overview_delta(o).first()) == (-50, 0, -50, 0, -50)


def test_zero_divisions_give_null(spark):
    s = sessions(spark, {"at": "2024-01-30 00:00:00"})
    assert R.cost_by_project(s, AS_OF).first().cache_hit_pct is None
    assert R.cache_savings(s, AS_OF).count() == 0
    t = calls(spark, ("s", "Edit", "2024-01-01 00:00:00"))
    assert R.write_read_ratio(t).first().write_read_ratio is None


def test_weeks_cross_sunday(spark):
    t = calls(spark, ("s", "Edit", "2024-01-07 23:59:59"), ("s", "Read", "2024-01-08 00:00:00"), ("s", "Write", "2024-01-08 00:00:00"))
    assert [(r.week, r.writes, r.reads) for r in R.write_read_ratio(t).collect()] == [
        (dt.date(2024, 1, 1), 1, 0), (dt.date(2024, 1, 8), 1, 1),
    ]
    many = calls(spark, *[("s", "Edit", f"2024-0{1 + i // 4}-{1 + 7 * (i % 4):02d} 00:00:00") for i in range(12)])
    weeks = [r.week for r in R.write_read_ratio(many, weeks=8).collect()]
    assert len(weeks) == 8 and weeks == sorted(weeks)


def test_unset_message_count_is_long(spark):
    s = sessions(spark, {"at": "2024-01-30 00:00:00", "n": None}, {"at": "2024-01-30 00:00:00", "n": 2})
    assert [(r.bucket, r.avg_msgs) for r in R.session_buckets(s, AS_OF).collect()] == [("abandoned", 2.0), ("long", None)]


def test_tool_share_is_taken_before_the_limit(spark):
    t = calls(spark, *[("s", name, "2024-01-30 00:00:00") for name in "AAABBC"])
    assert [(r.tool_name, r.calls, r.pct) for r in R.tool_share(t, AS_OF, limit=2).collect()] == [("A", 3, 50.0), ("B", 2, 33.3)]
    whole = R.tool_share(t, AS_OF, limit=None).collect()
    assert abs(sum(r.pct for r in whole) - 100) < 0.2
    assert R.tool_share(t.limit(0), AS_OF).count() == 0


def test_streaks(spark):
    days = ["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-03", "2024-03-01", "2024-03-02", "2024-03-03"]
    s = sessions(spark, *[{"at": f"{d} 10:00:00", "project": "a" if d < "2024-03" else "b"} for d in days + days[:1]], {"at": None})
    assert tuple(R.longest_streak(s).first()) == (3, dt.date(2024, 1, 30), dt.date(2024, 2, 1))
    by = {r.project_name: (r.streak_days, r.from_date) for r in R.longest_streak(s, by="project_name").collect()}
    assert by == {"a": (3, dt.date(2024, 1, 30)), "b": (3, dt.date(2024, 3, 1))}


def test_developer_type(spark):
    t = calls(spark, ("s", "Bash", None), ("s", "Zed", None), ("s", "Zed", None))
    assert tuple(R.developer_type(t).first()) == ("The Polyglot", "Zed")
    assert tuple(R.developer_type(t.where("tool_name = 'Bash'")).first()) == ("The Hacker", "Bash")
    assert tuple(R.developer_type(t.limit(0)).first()) == ("The Polyglot", "unknown")


def test_biggest_by_tokens_is_not_costliest(spark):
    s = sessions(spark, {"id": "tokens", "inp": 1000, "at": "2024-01-01 00:00:00"}, {"id": "cost", "out": 900, "at": "2024-01-02 00:00:00"})
    assert R.biggest_session(s).first().date == dt.date(2024, 1, 1)
    assert R.costliest_sessions(s, 1).first().created_on == dt.date(2024, 1, 2)


def test_search(spark):
    m = spark.createDataFrame(
        [("a", "1", "user", ts("2024-01-01 10:00:00"), "50% OFF " + "x" * 300), ("gone", "2", "user", None, "off"), ("a", "3", "user", None, None)],
        "session_id string, uuid string, type string, timestamp timestamp, text_content string",
    )
    s = sessions(spark, {"id": "a", "project": "proj", "at": None})
    got = [tuple(r)[:4] + (len(r.content),) for r in R.search_messages(m, s, "off").collect()]
    assert got == [("a", "proj", "user", "01-01 10:00", 200), ("gone", None, "user", None, 3)]
    h = spark.createDataFrame(
        [("f1", "c", "g", ts("2024-01-01 00:00:00"), "plain", "has a\\b"), ("f2", "c", None, None, "a\\B title", None)],
        "file_path string, category string, agent string, timestamp timestamp, description string, content string",
    )
    assert [(r.date, r.description) for r in R.search_history(h, "A\\b").collect()] == [("01-01", "plain"), (None, "a\\B title")]


def test_table_stats_counts_missing_tables_as_zero(spark):
    s = sessions(spark, {"at": None}, {"at": None})
    assert {r.table_name: r.rows for r in R.table_stats({"sessions": s}).collect()} == {
        **{n: 0 for n in R.COUNTED_TABLES}, "sessions": 2,
    }


def test_zero_limits_are_errors(spark):
    s = sessions(spark, {"at": None})
    for call in (
        lambda: R.tokens_by_project(s, AS_OF, days=0), lambda: R.recent_sessions(s, limit=0), lambda: R.search_messages(s, s, ""),
    ):
        with pytest.raises(ValueError):
            call()


def test_cost_by_model_and_trend(spark):
    m = spark.createDataFrame(
        [("x-Haiku-3", 1_000_000, 1_000_000, 1_000_000), ("x-opus", 1_000_000, 0, 1_000_000), ("mystery", 1, 1, 1), (None, 1, 1, 1)],
        "model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint",
    )
    got = {r.model: (r.family, r.est_cost_usd) for r in I.cost_by_model(m).collect()}
    assert got == {"x-Haiku-3": ("haiku", 1.53), "x-opus": ("opus", 16.5), "mystery": (None, None)}
    s = sessions(
        spark, {"at": "2024-01-01 00:00:00", "inp": 1_000_000}, {"at": "2024-01-08 00:00:00", "inp": 2_000_000},
        {"at": "2024-01-15 00:00:00", "inp": 2_000_000}, {"at": "2024-01-22 00:00:00", "inp": 1_000_000},
    )
    assert [(r.change_usd, r.change_pct, r.trend) for r in I.spend_trend(s).orderBy("week").collect()] == [
        (None, None, None), (3.0, 100, "up"), (0.0, 0, "flat"), (-3.0, -50, "down"),
    ]
    assert I.month_spend(s, AS_OF).first().est_cost_usd == 18.0
    assert I.top_prompts(sessions(spark, {"prompt": " Hi "}, {"prompt": "hi"}, {"prompt": None})).first().sessions == 2


def test_purged_session_counts_once(spark):
    """A session in both tables is a session; the index entry is left out by an anti-join."""
    s = sessions(spark, {"id": "a"}, {"id": "b"})
    d = spark.createDataFrame([("a",), ("c",)], "session_id string")
    only_deleted = d.join(s, "session_id", "left_anti")
    assert s.count() + only_deleted.count() == 3


@pytest.mark.parametrize(
    "text",
    [
        "INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT * FROM one",
        "CREATE TABLE never AS SELECT * FROM one",
        "DROP VIEW one",
        "SET spark.sql.shuffle.partitions=3",
    ],
)
def test_raw_sql_takes_queries_only(spark, text):
    one = spark.range(1)
    with pytest.raises(ParseException):
        R.sql(spark, text, {"one": one})
    assert R.sql(spark, "WITH x AS (SELECT id FROM one) SELECT id FROM x -- a note", {"one": one}).count() == 1
    assert R.sql(spark, "SELECT id FROM one;", {"one": one}).count() == 1
