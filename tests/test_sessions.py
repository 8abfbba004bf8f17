import random
from datetime import timedelta
from functools import reduce

import pytest
from conftest import at, rows
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import tidemark as tm


def brute_force(events, gap=30):
    """(user, event_id) -> session index, counting minute boundaries event by event."""
    index, state = {}, {}
    for user, ts, event_id in sorted(events, key=lambda e: (e[0] or "", e[1], e[2])):
        minute = ts.replace(second=0, microsecond=0)
        previous, current = state.get(user, (None, 0))
        if previous is None or (minute - previous) > timedelta(minutes=gap):
            current += 1
        state[user] = (minute, current)
        index[user, event_id] = current
    return index


@pytest.mark.parametrize("ts", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize(
    "times, sessions",
    [
        (("10:00:59", "10:31:00"), 2),
        (("10:00:00", "10:30:59.9"), 1),
        (("10:00:00", "10:30:00"), 1),
        (("23:45:00", "2026-03-03 00:15:00"), 1),
        (("10:00:00", "10:00:00"), 1),
    ],
)
def test_gap_counts_minute_boundaries(make_events, ts, times, sessions):
    events = make_events([{"event_ts": t} for t in times], ts)
    assert tm.session_summary(events).count() == sessions
    assert tm.sessionise(events).agg({"session_index": "max"}).first()[0] == sessions


@pytest.mark.parametrize("ts", ["timestamp_ntz", "timestamp"])
def test_session_seconds_count_second_boundaries(make_events, ts):
    events = make_events([{"event_ts": "10:00:00.9"}, {"event_ts": "10:00:01.0"}], ts)
    assert rows(tm.session_summary(events), "session_seconds") == [(1,)]


def test_times_before_1970(make_events):
    events = make_events([{"event_ts": "1969-12-31 23:20:59"}, {"event_ts": "1969-12-31 23:51:00"}])
    assert tm.session_summary(events).count() == 2


def test_summary_of_a_session(make_events):
    events = make_events(
        [
            {"event_ts": "10:00:00", "revenue": 1.5},
            {"event_ts": "10:10:30", "event_name": "purchase", "revenue": 10.0},
            {"event_ts": "12:00:00"},
            {"user_id": "u2", "event_ts": "10:05:00"},
        ]
    )
    columns = "session_id session_start session_end session_seconds event_count session_revenue converted"
    assert rows(tm.session_summary(events), *columns.split()) == [
        ("u1_s1", at("10:00:00"), at("10:10:30"), 630, 2, 11.5, 1),
        ("u1_s2", at("12:00:00"), at("12:00:00"), 0, 1, 0.0, 0),
        ("u2_s1", at("10:05:00"), at("10:05:00"), 0, 1, 0.0, 0),
    ]


def test_gap_is_a_parameter(make_events):
    events = make_events([{"event_ts": "10:00:00"}, {"event_ts": "10:06:00"}])
    assert tm.session_summary(events, gap_minutes=5).count() == 2
    assert tm.session_summary(events, gap_minutes=6).count() == 1


def test_events_without_a_user_stay_together(make_events):
    events = make_events([{"user_id": None}, {"user_id": None, "event_ts": "10:05:00"}])
    assert rows(tm.sessionise(events), "user_id", "session_index") == [(None, 1), (None, 1)]
    assert rows(tm.session_summary(events), "session_id", "event_count") == [(None, 2)]


@pytest.mark.parametrize("ts", ["timestamp_ntz", "timestamp"])
def test_random_events_match_brute_force(make_events, ts):
    """One user has a third of the events; times cluster around the gap length."""
    rng = random.Random(11)
    events = []
    for i in range(1500):
        user = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        offset = rng.choice([0, 1, 29, 30, 31, 45]) * 60 * rng.randrange(40) + rng.choice([0, 0.5, 59.9])
        events.append((user, at("00:00:00") + timedelta(seconds=offset), f"e{i:05d}"))
    expected = brute_force(events)
    table = make_events([{"user_id": u, "event_ts": t, "event_id": e} for u, t, e in events], ts)
    got = {(r.user_id, r.event_id): r.session_index for r in tm.sessionise(table).collect()}
    assert got == expected

    counts = {}
    for (user, _), session in expected.items():
        counts[user, session] = counts.get((user, session), 0) + 1
    summary = tm.session_summary(table).collect()
    assert {(r.user_id, r.session_index): r.event_count for r in summary} == counts
    assert tm.session_count(table).first().events == len(events)


def test_sessionise_keeps_the_columns_it_is_given(make_events):
    events = make_events([{}]).withColumn("minute", F.lit(99))
    numbered = tm.sessionise(events)
    assert numbered.columns == [*events.columns, "session_index"]
    assert rows(numbered, "minute", "session_index") == [(99, 1)]


def test_naive_times_ignore_the_session_zone(make_events, spark):
    """02:00 to 03:00 does not exist on that night in New York, but does in a naive column."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        events = make_events(
            [{"event_ts": f"2026-03-08 {t}"} for t in ("01:50:00", "02:20:00", "02:50:00", "03:20:30")]
        )
        summary = tm.session_summary(events)
        assert rows(summary, "session_seconds", "event_count") == [(5430, 4)]
        assert rows(tm.first_touch_users(events), "signup_week") == [(at("2026-03-02 00:00:00"),)]
        assert rows(tm.circular_mean_hour(events.limit(1)), "mean_hour")[0][0] == pytest.approx(1.0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_an_undated_event_stops_the_operators(make_events):
    events = make_events([{}, {"event_ts": None}])
    for numbered in (tm.sessionise(events), tm.session_summary(events), tm.session_count(events)):
        with pytest.raises(Exception, match="no event_ts"):
            numbered.collect()


@pytest.fixture
def many_ranges(spark):
    """More ranges than users, none of them merged again."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("seed", range(3))
def test_sessions_go_on_across_ranges(make_events, spark, many_ranges, seed):
    """A hot user, a NULL user and many small ones over 40 ranges; long runs within one minute too."""
    rng = random.Random(seed)
    events, users = [], ["hot", "hot", "hot", None, *"abcdefghij"]
    for i in range(1200):
        minutes = rng.choice([0, 0, rng.randrange(3000), 30 * rng.randrange(100), 31 * rng.randrange(100)])
        events.append((rng.choice(users), at("00:00:00") + timedelta(minutes=minutes, seconds=rng.randrange(60)), f"e{i:05d}"))
    table = make_events([{"user_id": u, "event_ts": t, "event_id": e} for u, t, e in events])
    assert {(r.user_id, r.event_id): r.session_index for r in tm.sessionise(table).collect()} == brute_force(events)


def test_one_user_spreads_over_ranges_and_events_are_read_once(make_events, spark, many_ranges, tmp_path):
    """Even one user at one time, told apart by ids."""
    make_events([{"event_ts": "10:00:00", "platform": f"p{i}"} for i in range(2000)]).write.parquet(f"{tmp_path}/e")
    events = spark.read.parquet(f"{tmp_path}/e")
    numbered = tm.sessionise(events)
    assert rows(numbered.groupBy("session_index").count()) == [(1, 2000)]
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Exchange" not in plan
    assert plan.count("Scan parquet") == 1 and f"{tmp_path}/e" not in plan
    files = [spark.read.parquet(f) for f in numbered.inputFiles()]
    sizes = [r["count"] for r in reduce(DataFrame.unionByName, files).groupBy("_range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 200


def test_ids_of_any_type(make_events):
    events = make_events([{"user_id": u, "event_ts": t} for u, t in (("1", "10:00:00"), ("1", "11:00:00"), (None, "09:00:00"), ("2", "10:00:00"))])
    for kind in ("bigint", "int", "double", "decimal(20,0)", "string", "binary"):
        numbered = tm.sessionise(events.withColumn("user_id", F.col("user_id").cast("string" if kind == "binary" else kind).cast(kind)))
        assert sorted(r.session_index for r in numbered.collect()) == [1, 1, 1, 2]
    assert tm.sessionise(events.limit(0)).count() == 0
    assert tm.sessionise(events.drop("event_id")).count() == 4
