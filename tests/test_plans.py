"""What the physical plans must and must not contain, and the whole report."""

import json
from pathlib import Path

import pytest
from conftest import rows
from test_funnel import ladder

import tidemark as tm
from tidemark.operators import quality


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(make_events, tmp_path_factory):
    events = [e for i in range(40) for e in ladder(f"u{i}", 1 + i % 5, ["organic", "paid_search"][i % 2], 9.0)]
    root = str(tmp_path_factory.mktemp("tables"))
    raw = tm.save_table(make_events(events), f"{root}/raw")
    return raw, tm.build_models(raw, f"{root}/models")


@pytest.fixture(scope="module")
def frames(tables):
    raw, models = tables
    events, users = models["stg_events"], models["stg_users"]
    return {
        "clean_events": tm.clean_events(raw),
        "first_touch_users": tm.first_touch_users(events),
        "sessionise": tm.sessionise(events),
        "session_summary": tm.session_summary(events),
        "funnel": tm.funnel(events),
        "funnel_by": tm.funnel_by(events, users),
        "opportunity": tm.opportunity(tm.funnel(events), events),
        "retention": tm.retention(events, users),
        "retention_by_segment": tm.retention_by_segment(models["mart_retention"], events),
        "retention_curve": tm.retention_curve(events, users),
        "two_proportion_test": tm.two_proportion_test(users, events),
        "quality_audit": tm.quality_audit(raw, events),
        "hour_skew": quality.hour_skew(events),
        "hour_spread": quality.hour_spread(events),
        "suite": tm.run_suite(models),
    }


def test_no_pairing_of_all_rows_and_no_python(frames):
    for name, df in frames.items():
        text = plan(df)
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Expand"):
            assert node not in text, f"{name} plans {node}"


def test_copies_are_reduced_before_the_shuffle(frames):
    text = plan(frames["clean_events"])
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    assert "PushedFilters: [IsNotNull(user_id)]" in text


def test_sessions_window_runs_on_minutes_after_a_partial_aggregate(frames):
    text = plan(frames["session_summary"])
    assert text.count("Exchange hashpartitioning") == 2
    below = text[text.rindex("Exchange hashpartitioning") :]
    assert "partial_min(event_ts" in below and "Window" not in below


def test_scans_read_only_what_is_needed(frames):
    for name, columns in {
        "funnel": "user_id:string,event_name:string,revenue:double",
        "first_touch_users": "event_id:string,user_id:string,event_ts:timestamp_ntz,channel:string,platform:string",
        "session_summary": "user_id:string,event_name:string,event_ts:timestamp_ntz,revenue:double",
    }.items():
        assert f"ReadSchema: struct<{columns}>" in plan(frames[name])


def test_events_are_scanned_once_per_funnel(frames):
    assert plan(frames["funnel"]).count("FileScan") == 1
    assert plan(frames["quality_audit"]).count("FileScan") == 2


def executed(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def scans(text, table):
    """Scans of a table that ran: a reused exchange is printed without its scan."""
    return sum("FileScan" in line and f"/{table}/v-" in line for line in text.splitlines())


def test_suite_scans_the_events_five_times_at_most(tables):
    assert 1 <= scans(executed(tm.run_suite(tables[1])), "stg_events") <= 5


def test_sessionise_reads_its_own_copy_once(tables):
    events = tables[1]["stg_events"]
    text = executed(tm.sessionise(events))
    assert scans(text, "stg_events") == 0 and text.count("FileScan") == 1 and "Join" not in text


def test_models_are_saved_by_name(tables):
    raw, models = tables
    assert list(models) == (
        "raw_events stg_events stg_users mart_sessions mart_funnel mart_retention audit_data_quality"
    ).split()
    for name, table in models.items():
        if name != "raw_events":
            assert table.inputFiles()[0].split("/")[-3] == name


def test_report_is_written_as_json(tables, tmp_path):
    raw, _ = tables
    report = tm.question_report(raw, f"{tmp_path}/models")
    assert list(report) == (
        "funnel retention_by_channel week_one channel_comparison opportunity data_quality method"
    ).split()
    tm.write_report(report, f"{tmp_path}/out")
    for name, answer in report.items():
        lines = [json.loads(x) for f in Path(tmp_path, "out", name).glob("*.json") for x in f.open()]
        assert len(lines) == answer.count()
        assert set(lines[0]) == set(answer.columns)
    assert rows(report["week_one"]) == [(40, 40, 1.0)]
