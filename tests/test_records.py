"""Golden cases of the transcript rules: one small directory each."""

from __future__ import annotations

import datetime as dt

from tests.conftest import rec
from tracewell.operators import records as O
from tracewell.sources import files, ranges
from tracewell.sources.transcripts import scan_transcripts


def load(spark, tree, **kw):
    parsed = O.parse_records(scan_transcripts(spark, tree.root), **kw).cache()
    sessions = O.summarize_files(parsed).cache()
    return (
        {r.session_id: r for r in sessions.collect()},
        {(r.session_id, r.uuid): r for r in O.messages_of(parsed, sessions).collect()},
        {(r.session_id, r.message_uuid, r.idx): r for r in O.tool_calls_of(parsed, sessions).collect()},
        {r.file_path.rsplit("/", 1)[1]: r.reason for r in O.quarantine(parsed)[1].collect()},
    )


def test_replay_counts_twice_but_keeps_last_row(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a", tokens=(1, 2, 3, 4)), rec("b"), rec("a", tokens=(10, 20, 30, 40))])
    ses, msg, _, _ = load(spark, tree)
    s = ses["S"]
    assert (s.message_count, s.total_input_tokens, s.total_output_tokens) == (3, 11, 22)
    assert (s.total_cache_read, s.total_cache_write) == (33, 44)
    assert len(msg) == 2 and msg["S", "a"].input_tokens == 10


def test_replay_of_tool_calls(spark, tree):
    use = lambda name, n: {"type": "tool_use", "name": name, "input": {"n": n}}
    tree.jsonl("p/S.jsonl", [rec("a", [use("Read", 1), use("Edit", 2)]), rec("a", [use("Bash", 3)])])
    _, msg, calls, _ = load(spark, tree)
    assert {k[2]: (r.tool_name, r.tool_input) for k, r in calls.items()} == {0: ("Bash", '{"n":3}'), 1: ("Edit", '{"n":2}')}
    assert msg["S", "a"].tool_name == "Bash"


def test_string_content(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a", "fix it", type="user")])
    ses, msg, _, _ = load(spark, tree)
    assert ses["S"].first_prompt == "fix it" and msg["S", "a"].text_content is None
    _, msg, _, _ = load(spark, tree, include_string_content=True)
    assert msg["S", "a"].text_content == "fix it"


def test_blocks(spark, tree):
    content = [
        "bare", {"type": "text", "text": "one"}, {"type": "tool_use", "name": "Read", "input": {"b": 1, "a": [1, "é"]}},
        {"type": "text"}, {"type": "tool_use", "name": ""}, 7, {"no": "type"}, ["x"],
    ]
    tree.jsonl("p/S.jsonl", [rec("a", content)])
    ses, msg, calls, _ = load(spark, tree)
    m = msg["S", "a"]
    assert m.content_types == ["text", "tool_use", ""]
    assert m.text_content == "bare\none\n"
    assert (m.tool_name, m.tool_input_summary) == ("Read", '{"a":[1,"é"],"b":1}')
    assert {k[2]: (r.tool_name, r.tool_input) for k, r in calls.items()} == {2: ("Read", '{"a":[1,"é"],"b":1}'), 4: ("", "{}")}
    assert ses["S"].tools_used == ["", "Read"]


def test_first_named_tool_wins_and_all_empty_gives_empty(spark, tree):
    use = lambda name, n: {"type": "tool_use", "name": name, "input": {"n": n}}
    tree.jsonl("p/S.jsonl", [rec("a", [use("", 1), use("Bash", 2), use("Read", 3)]), rec("b", [use("", 1), use("", 2)]), rec("c", [])])
    _, msg, _, _ = load(spark, tree)
    assert (msg["S", "a"].tool_name, msg["S", "a"].tool_input_summary) == ("Bash", '{"n":2}')
    assert (msg["S", "b"].tool_name, msg["S", "b"].tool_input_summary) == ("", '{"n":2}')
    assert (msg["S", "c"].tool_name, msg["S", "c"].content_types, msg["S", "c"].text_content) == (None, None, None)


def test_first_prompt_order(spark, tree):
    rows = [
        rec("a", "side", type="user", isSidechain=True),
        rec("b", [{"type": "image"}], type="user"),
        rec("c", "not mine", type="assistant"),
        rec("d", [{"type": "image"}, {"type": "text", "text": "mine"}], type="user", isSidechain=None),
        rec("e", "late", type="user"),
    ]
    tree.jsonl("p/S.jsonl", rows)
    ses, msg, _, _ = load(spark, tree)
    assert ses["S"].first_prompt == "mine"
    assert msg["S", "a"].is_sidechain is True and msg["S", "c"].is_sidechain is False
    assert msg["S", "d"].is_sidechain is None


def test_empty_first_prompt_counts_as_found(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a", "", type="user"), rec("b", "later", type="user")])
    assert load(spark, tree)[0]["S"].first_prompt == ""


def test_late_session_id(spark, tree):
    rows = [rec("a", sessionId=...), rec("b", cwd="/w", version="1", gitBranch="main"), rec("c", sessionId="T", cwd="/x")]
    tree.jsonl("proj/stem.jsonl", rows)
    ses, msg, _, _ = load(spark, tree)
    assert set(msg) == {("stem", "a"), ("S", "b"), ("S", "c")}
    s = ses["S"]
    assert (s.cwd, s.version, s.git_branch, s.project_name, s.is_subagent) == ("/w", "1", "main", "proj", False)
    assert s.project_path == f"{tree.root}/proj" and s.file_path == f"{tree.root}/proj/stem.jsonl"


def test_no_session_id_uses_stem(spark, tree):
    tree.jsonl("proj/my.name.jsonl", [rec("a", sessionId="", cwd="/ignored")])
    ses, msg, _, _ = load(spark, tree)
    assert ses["my.name"].cwd is None and ("my.name", "a") in msg


def test_nulls_of_the_naming_record_stay(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a", cwd=None), rec("b", cwd="/later", version="2")])
    s = load(spark, tree)[0]["S"]
    assert (s.cwd, s.version) == (None, None)


def test_subagent(spark, tree):
    tree.jsonl("proj/parent/subagents/agent-1.jsonl", [rec("a", [{"type": "tool_use", "name": "Read"}])])
    ses, msg, calls, _ = load(spark, tree)
    s = ses["agent-1"]
    assert (s.is_subagent, s.parent_session_id, s.project_name) == (True, "parent", "proj")
    assert ("agent-1", "a") in msg and ("agent-1", "a", 0) in calls


def test_timestamps(spark, tree):
    stamps = {
        "a": "2024-01-01T10:00:00.250Z", "b": "2024-01-01T09:30:00+02:00", "c": "2024-01-01 23:00", "d": "nonsense",
        "e": 5, "f": None, "g": "2024-01-02", "h": "2024-01-01T10:00:00.1234567Z", "i": "2024",
    }
    tree.jsonl("p/S.jsonl", [rec(u, timestamp=t) for u, t in stamps.items()])
    parsed = O.parse_records(scan_transcripts(spark, tree.root))
    got = {r.uuid: r.ts for r in parsed.selectExpr("uuid", "cast(timestamp as string) ts").collect()}
    assert got == {
        "a": "2024-01-01 10:00:00.25", "b": "2024-01-01 07:30:00", "c": "2024-01-01 23:00:00", "d": None,
        "e": None, "f": None, "g": "2024-01-02 00:00:00", "h": "2024-01-01 10:00:00.123456", "i": None,
    }
    s = O.summarize_files(parsed).selectExpr("cast(created_at as string) c", "cast(modified_at as string) m").first()
    assert (s.c, s.m) == ("2024-01-01 07:30:00", "2024-01-02 00:00:00")


def test_bad_lines_are_skipped(spark, tree):
    rows = [
        "", "   ", "{bad", '{"uuid":"x"} trailing', '{"uuid":"x"}{"uuid":"y"}', '{"uuid":"x"}] ]', rec("s", type="file-history-snapshot"),
        rec(""), rec(None), rec(...), rec(0), "  " + '{"uuid":"ok","sessionId":"S","sessionId":"U"}' + "  ", rec("b", sessionId="U"),
    ]
    tree.jsonl("p/S.jsonl", rows)
    ses, msg, _, bad = load(spark, tree)
    assert set(msg) == {("U", "ok"), ("U", "b")} and not bad
    assert msg["U", "ok"].type == "" and msg["U", "ok"].role is None


def test_bad_files_are_rejected_whole(spark, tree):
    good = rec("a")
    cases = {
        "list": "[1]", "scalar": "12", "null": "null", "message": rec("b", message=None), "message2": rec("b", message="x"),
        "usage": rec("b", message={"usage": None}), "usage2": rec("b", message={"usage": 3}),
        "text": rec("b", [{"type": "text", "text": None}]), "text2": rec("b", [{"type": "text", "text": 5}]),
        "token": rec("b", tokens=("12",)), "token2": rec("b", tokens=(1, [1])), "model": rec("b", model={"a": 1}),
        "name": rec("b", [{"type": "tool_use", "name": ["x"]}]), "uuid": rec(["b"]),
    }
    for name, line in cases.items():
        tree.jsonl(f"p/{name}.jsonl", [good, line])
    tree.write("p/bytes.jsonl", b'{"uuid":"a"}\n{"uuid":"\xff"}\n')
    tree.jsonl("p/fine.jsonl", [good, rec("b", tokens=(None, "", [], False)), rec("c", [{"type": "image", "text": None}], model="")])
    ses, msg, _, bad = load(spark, tree)
    assert set(bad) == {f"{n}.jsonl" for n in cases} | {"bytes.jsonl"}
    assert {r.file_path.rsplit("/", 1)[1] for r in ses.values()} == {"fine.jsonl"} and len(msg) == 3
    parsed = O.parse_records(scan_transcripts(spark, tree.root))
    by_line, _ = O.quarantine(parsed, on_error="line")
    assert by_line.count() == len(cases) + 1 + 3
    assert O.summarize_files(parsed, on_error="line").count() == len(cases) + 2


def test_snapshot_is_not_checked_further(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a"), rec("b", type="file-history-snapshot", message=None), rec("", message=None)])
    ses, msg, _, bad = load(spark, tree)
    assert len(msg) == 1 and not bad


def test_null_tool_name_stays_a_row(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a", [{"type": "tool_use", "name": None}, {"type": "tool_use", "name": "Read"}])])
    ses, msg, calls, _ = load(spark, tree)
    assert calls["S", "a", 0].tool_name is None and msg["S", "a"].tool_name == "Read"
    assert ses["S"].tools_used == ["Read"]


def test_values_are_stored_whole(spark, tree):
    long = "é" * 3000
    rows = [rec("a", [{"type": "text", "text": long}, {"type": "tool_use", "name": "Write", "input": {"t": long}}], type="user")]
    tree.jsonl("p/S.jsonl", rows)
    ses, msg, calls, _ = load(spark, tree)
    assert ses["S"].first_prompt == msg["S", "a"].text_content == long
    assert msg["S", "a"].tool_input_summary == calls["S", "a", 1].tool_input == '{"t":"' + long + '"}'


def test_models_and_tools_are_sorted_sets(spark, tree):
    use = lambda *names: [{"type": "tool_use", "name": n} for n in names]
    tree.jsonl("p/S.jsonl", [rec("a", use("Read", "Bash"), model="m2"), rec("b", use("Bash"), model="m1"), rec("c", model="m2")])
    s = load(spark, tree)[0]["S"]
    assert (s.tools_used, s.models_used) == (["Bash", "Read"], ["m1", "m2"])


def test_order_holds_over_splits_of_one_file(spark, tree):
    rows = [rec("a", "first" if i == 0 else f"p{i}", type="user", tokens=(i,), timestamp=None) for i in range(3000)]
    tree.jsonl("p/S.jsonl", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = scan_transcripts(spark, tree.root)
        assert lines.select("block_start").distinct().count() > 5
        ses, msg, _, _ = load(spark, tree)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ses["S"].first_prompt == "first" and ses["S"].message_count == 3000
    assert msg["S", "a"].input_tokens == 2999


def test_paths_with_odd_characters(spark, tree):
    path = tree.jsonl("-home-a b+c%20é/S.jsonl", [rec("a")])
    s = load(spark, tree)[0]["S"]
    assert s.file_path == path and s.project_name == "-home-a b+c%20é"


def test_listing_and_feeds(spark, tree):
    old = tree.jsonl("p/old.jsonl", [rec("a")], 1000.0)
    new = tree.jsonl("p/new.jsonl", [rec("a")], 2000.5)
    sub = tree.jsonl("p/x/subagents/s.jsonl", [rec("a")], 1500.0)
    tree.write("p/other.txt", "x", 3000.0)
    assert [r.file_path for r in files.list_newer(spark, tree.root, ".jsonl", 1000_000, recurse=True).collect()] == [sub, new]
    assert files.list_newer(spark, tree.root, ".jsonl", 0).count() == 0
    assert files.list_newer(spark, tree.root + "/none", ".jsonl", 0).count() == 0
    paths = lambda df: {r.file_path for r in df.select("file_path").distinct().collect()}
    assert paths(scan_transcripts(spark, tree.root, 1001_000, 1500_000)) == {new, sub}
    assert paths(scan_transcripts(spark, tree.root, session_id="old")) == {old}
    assert paths(scan_transcripts(spark, tree.root, session_id="s")) == set()


def test_old_files_are_not_opened(spark, tree, monkeypatch):
    for i in range(5):
        tree.jsonl(f"p/{i}.jsonl", [rec("a")], 1000.0 + i)
    newest = f"{tree.root}/p/4.jsonl"
    opened = []
    ranges_of = ranges.splits

    def watched(chosen, start):
        opened.extend(r.file_path for r in chosen.collect())
        return ranges_of(chosen, start)

    monkeypatch.setattr(ranges, "splits", watched)
    assert scan_transcripts(spark, tree.root, 1004_000, 0).count() == 1
    assert opened == [newest]


def test_datetime_type(spark, tree):
    tree.jsonl("p/S.jsonl", [rec("a")])
    s = load(spark, tree)[0]["S"]
    assert isinstance(s.created_at, dt.datetime)
