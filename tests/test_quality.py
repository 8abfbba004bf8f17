import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import at, rows
from pyspark.sql import functions as F
from test_funnel import ladder

import tidemark as tm
from tidemark import defaults


def by_hour(platform, hours, copies=1):
    start = datetime(2026, 3, 2)
    return [
        {"platform": platform, "event_ts": start + timedelta(hours=h, seconds=i)}
        for h in hours
        for i in range(copies)
    ]


def test_audit_counts_what_cleaning_removed(make_events):
    raw = make_events(
        [
            {"user_id": "a"},
            {"user_id": "a"},
            {"user_id": "a"},
            {"user_id": "b"},
            {"user_id": None},
            {"user_id": None},
            {"user_id": "c", "platform": "ios"},
            {"user_id": "c", "platform": "ios"},
        ]
    )
    row = tm.quality_audit(raw, tm.clean_events(raw)).first()
    assert tuple(row) == (8, 3, 5, 3, 0.375, 2, 0.25, 3)
    assert row.rows_removed == row.duplicate_rows + row.null_user_rows


def test_audit_with_a_key_that_has_no_user(make_events):
    raw = make_events(
        [{"user_id": "a"}, {"user_id": "b"}, {"user_id": "b"}, {"user_id": None}, {"user_id": "c", "event_ts": "11:00:00"}]
    )
    key = ("event_name", "event_ts")
    row = tm.quality_audit(raw, tm.clean_events(raw, key=key), key).first()
    assert tuple(row) == (5, 2, 3, 2, 0.4, 1, 0.2, 2)
    assert row.rows_removed == row.duplicate_rows + row.null_user_rows


def test_audit_of_nothing(make_events):
    raw = make_events([]).limit(0)
    assert tuple(tm.quality_audit(raw, tm.clean_events(raw)).first()) == (0, 0, 0, 0, None, 0, None, 0)


def test_circular_mean_wraps_at_midnight(make_events):
    events = make_events(by_hour("web", [23, 1]) + by_hour("ios", [22, 22, 22, 18]) + by_hour("android", [6]))
    hours = {r.platform: (r.rows, r.mean_hour) for r in tm.circular_mean_hour(events).collect()}
    assert hours["web"][0] == 2
    assert min(hours["web"][1], 24 - hours["web"][1]) == pytest.approx(0, abs=1e-9)
    assert hours["android"] == (1, pytest.approx(6.0))
    assert 21 < hours["ios"][1] < 22


def test_hour_skew_measures_around_the_clock(make_events):
    events = make_events(by_hour("android", [23]) + by_hour("ios", [1]) + by_hour("web", [4]))
    assert rows(tm.hour_skew(events, min_rows=0)) == [("android", "web", 23.0, 4.0, 5.0)]
    assert tm.hour_skew(events, min_rows=0, max_hours=1.5).count() == 3
    assert tm.hour_skew(events, min_rows=1).count() == 0


@pytest.mark.parametrize("limit", [0.0, 0.4, 1.0, 2.99, 3.0, 5.5, 11.0, 12.0, 13.0])
def test_hour_skew_bins_miss_no_pair(make_events, limit):
    hours = {f"p{h:02d}": h for h in range(0, 24)}
    events = make_events([e for p, h in hours.items() for e in by_hour(p, [h])])
    apart = lambda a, b: min((a - b) % 24, (b - a) % 24)
    expected = [(p, q) for p, a in hours.items() for q, b in hours.items() if p < q and apart(a, b) > limit]
    got = tm.hour_skew(events, min_rows=0, max_hours=limit)
    assert rows(got, "platform_a", "platform_b") == sorted(expected)


def test_shifted_platform_shows_before_cleaning_only(make_events):
    evening = [17, 18, 19, 20]
    raw = make_events(by_hour("ios", [h - 8 for h in evening]) + by_hour("web", evening))
    assert rows(tm.hour_skew(raw, min_rows=0), "hours_apart") == [(8.0,)]
    assert tm.hour_skew(tm.clean_events(raw), min_rows=0).count() == 0


def test_hour_spread_agrees_with_the_pairs(make_events):
    hours = {f"p{h:02d}": h for h in (0, 1, 2, 9, 10, 20, 23)}
    events = make_events([e for p, h in hours.items() for e in by_hour(p, [h])])
    apart = lambda a, b: min((a - b) % 24, (b - a) % 24)
    expected = [(p, float(a), float(max(apart(a, b) for b in hours.values()))) for p, a in hours.items()]
    assert rows(tm.hour_spread(events, min_rows=0)) == expected
    assert tm.hour_spread(events, min_rows=1).count() == 0
    off = tm.hour_spread(events, min_rows=0).filter("hours_apart > 11")
    pairs = tm.hour_skew(events, min_rows=0, max_hours=11)
    named = {r.platform_a for r in pairs.collect()} | {r.platform_b for r in pairs.collect()}
    assert {r.platform for r in off.collect()} == named


def test_dup_keys_and_null_rows(make_events):
    raw = make_events([{}, {}, {"user_id": None}, {"event_ts": "11:00:00"}])
    assert rows(tm.dup_keys(raw), "user_id", "n") == [("u1", 2)]
    assert rows(tm.null_rows(raw, "user_id")) == [(1,)]
    clean = tm.clean_events(raw)
    assert tm.dup_keys(clean).count() == tm.null_rows(clean, "user_id").count() == 0


def test_events_before_signup(make_events):
    late = [{"user_id": "late", "event_name": "signup", "event_ts": "11:00:00"}, {"user_id": "late"}]
    none = [{"user_id": "none"}]
    events = make_events(ladder("good", 3) + late + none)
    assert rows(tm.events_before_signup(events), "user_id") == [("late",)]


def test_repeat_signups(make_events):
    events = make_events(ladder("a", 2) + ladder("b", 1) + ladder("b", 1))
    assert rows(tm.repeat_signups(events)) == [("b", 2)]


def test_column_assertions(make_events):
    events = make_events([{"event_id": "x"}, {"event_id": "x", "channel": "tv"}, {"channel": None}])
    assert rows(tm.not_unique(events, "event_id")) == [("x", 2)]
    assert tm.not_unique(events, "channel").count() == 0
    assert rows(tm.missing(events, "channel"), "event_id") == [("e0002",)]
    assert rows(tm.bad_values(events, "channel", defaults.CHANNELS)) == [("tv", 1)]


def test_orphans_ignore_nulls(make_events):
    child = make_events([{"user_id": u} for u in ("a", "b", "b", None)])
    parent = make_events([{"user_id": u} for u in ("a", "a", None)])
    assert rows(tm.orphans(child, "user_id", parent, "user_id")) == [("b", 2)]
    assert rows(tm.orphan_rows(child, "user_id", parent, "user_id"), "event_id") == [("e0001",), ("e0002",)]


def test_funnel_and_retention_bounds(make_events, spark):
    growing = make_events(ladder("a", 1) + [{"user_id": u, "event_name": "activate"} for u in "ab"])
    assert rows(tm.funnel_not_monotonic(tm.funnel(growing))) == [(2, "activate", 2, 1)]
    mart = spark.createDataFrame(
        [("2026-03-02", "email", 5, 6, 1, 0), ("2026-03-02", "social", 5, 5, 5, 5)],
        "signup_date string, channel string, cohort_users bigint, d1_plus bigint, d7_plus bigint, d30_plus bigint",
    )
    assert rows(tm.retention_over_cohort(mart), "channel") == [("email",)]
    assert tm.retention_over_cohort(mart, ["d7_plus"]).count() == 0


def test_other_segment_columns(make_events, spark):
    events = make_events(ladder("a", 3) + ladder("b", 1))
    users = tm.first_touch_users(events)
    mart = tm.retention(events, users, by=["platform"])
    assert tm.retention_over_cohort(mart, by=["platform"]).columns[0] == "platform"
    expected = tm.expected_step_rates(spark, multipliers={"web": 1.0}, by="platform")
    off = tm.rate_mismatch(tm.funnel_by(events, users, by="platform"), expected, by="platform")
    assert rows(off, "platform", "step") == [("web", "activate"), ("web", "first_search")]


def test_segments_out_of_order(spark):
    rates = spark.createDataFrame(
        [("organic", 0.4), ("social", 0.4), ("email", 0.1), ("tv", 0.9), ("referral", None)], "channel string, rate double"
    )
    got = tm.segments_out_of_order(rates, "rate", ["organic", "paid_search", "social", "referral", "email"])
    assert rows(got) == [("organic", "social", 0.4, 0.4)]


def test_session_floor(make_events):
    events = make_events([{}, {"user_id": "u2"}, {"event_ts": "12:00:00"}])
    sessions, users = tm.session_summary(events), tm.first_touch_users(events)
    assert rows(tm.session_totals(sessions)) == [(3, 2)]
    assert tm.session_floor(sessions, users).count() == 0
    assert rows(tm.session_floor(sessions.filter("user_id = 'u2'"), users)) == [(1, 2)]


def test_session_gaps(make_events):
    events = make_events([{"event_ts": t} for t in ("10:00:00", "10:20:00", "11:00:00", "11:05:00")])
    numbered = tm.sessionise(events)
    assert tm.session_gaps(numbered).count() == 0
    assert rows(tm.session_gaps(numbered, gap_minutes=15)) == [("u1", 1, 20, False)]
    assert rows(tm.session_gaps(numbered, gap_minutes=45)) == [("u1", 2, 40, True)]


def test_rate_in_band_excludes_its_ends(spark):
    audit = spark.createDataFrame([(0.015, None)], "duplicate_rate double, null_user_rate double")
    assert tm.rate_in_band(audit, "duplicate_rate", *defaults.DUPLICATE_RATE_BAND).count() == 0
    assert rows(tm.rate_in_band(audit, "duplicate_rate", 0.015, 0.02)) == [("duplicate_rate", 0.015)]
    assert rows(tm.rate_in_band(audit, "null_user_rate", 0.0, 1.0)) == [("null_user_rate", None)]


def known_rates(make_events):
    """Events in which every channel passes each step at its expected rate."""
    events = []
    for channel, multiplier in defaults.CHANNEL_MULTIPLIERS.items():
        depth, alive = {}, 400
        for step in defaults.STEPS:
            alive = round(alive * min(defaults.STEP_RATES.get(step, 1.0) * multiplier, 0.99)) if depth else alive
            depth[step] = alive
        for i in range(400):
            events += ladder(f"{channel}{i}", sum(i < n for n in depth.values()), channel)
    return make_events(events)


def test_known_step_rates_are_recovered_per_channel(make_events, spark):
    events = known_rates(make_events)
    measured = tm.funnel_by(events, tm.first_touch_users(events))
    assert measured.filter("step_conversion is not null").count() == 20
    assert tm.rate_mismatch(measured, tm.expected_step_rates(spark)).count() == 0
    off = tm.expected_step_rates(spark, multipliers={"email": 0.9})
    assert tm.rate_mismatch(measured, off).count() == 4
    counts = [r.users_reached for r in tm.funnel(events).collect()]
    assert counts == sorted(counts, reverse=True)
    assert tm.repeat_signups(events).count() == tm.events_before_signup(events).count() == 0


def test_run_checks_reports_the_first_row(make_events):
    events = make_events([{}, {}])
    result = tm.run_checks(
        {"duplicates": tm.dup_keys(events), "nulls": tm.null_rows(events, "user_id")}
    ).collect()
    assert [(r.name, r.failed_rows) for r in result] == [("duplicates", 1), ("nulls", 0)]
    assert json.loads(result[0].first_row)["n"] == 2
    assert result[1].first_row is None


def test_column_checks_agree_with_single_ones(make_events):
    events = make_events(
        [{"user_id": None}, {"user_id": None, "channel": "tv"}, {"channel": "tv"}, {"channel": "fax"}, {"channel": None}]
    )
    single = tm.run_checks(
        {
            "user": tm.missing(events, "user_id"),
            "time": tm.missing(events, "event_ts"),
            "nulls": tm.null_rows(events, "user_id"),
            "no_nulls": tm.null_rows(events, "event_id"),
            "channel": tm.bad_values(events, "channel", defaults.CHANNELS),
            "platform": tm.bad_values(events, "platform", defaults.PLATFORMS),
        }
    )
    together = tm.run_column_checks(
        events,
        present={"user": "user_id", "time": "event_ts"},
        accepted={"channel": ("channel", defaults.CHANNELS), "platform": ("platform", defaults.PLATFORMS)},
        null_rows={"nulls": "user_id", "no_nulls": "event_id"},
    )
    assert rows(together) == rows(single)


@pytest.fixture(scope="module")
def planted(make_events):
    """A clean evening population with the three defects planted."""
    good = []
    for i in range(1200):
        platform = defaults.PLATFORMS[i % 3]
        for e in ladder(f"u{i}", 1 + i % 5, defaults.CHANNELS[i % 5]):
            shift = 8 if platform == "ios" else 0
            stamp = e["event_ts"].replace(hour=17 + i % 5) - timedelta(hours=shift)
            good.append({**e, "platform": platform, "event_ts": stamp})
    repeats = [e for i, e in enumerate(good) if i % 70 == 0]
    unknown = [{**e, "user_id": None} for i, e in enumerate(good) if i % 250 == 0]
    return make_events(good + repeats + unknown)


def test_suite_passes_on_clean_data(planted):
    suite = tm.run_suite(tm.build_models(planted)).collect()
    assert len(suite) == 28
    assert [r.name for r in suite if r.failed_rows] == []


def test_suite_fails_on_uncleaned_data(planted):
    suite = {r.name: r for r in tm.run_suite(tm.build_models(planted, clean=False)).collect()}
    failed = {name for name, r in suite.items() if r.failed_rows}
    assert {"no_duplicate_events", "no_null_user_ids", "no_platform_hour_skew"} <= failed
    assert {"not_null_stg_events_user_id", "not_null_stg_users_user_id"} <= failed
    assert json.loads(suite["no_null_user_ids"].first_row) == {"null_rows": suite["not_null_stg_events_user_id"].failed_rows}
    assert json.loads(suite["no_platform_hour_skew"].first_row)["platform"] == "android"
    assert json.loads(suite["no_duplicate_events"].first_row)["n"] == 2


def at_hours(spark, hours):
    """Events of groups whose circular means are the given fractions of an hour, two hours mixed each."""
    rows_ = []
    for group, (hour, weight) in enumerate(hours):
        rows_ += [(group, at("00:00:00").replace(hour=hour))] * weight + [(group, at("00:00:00").replace(hour=(hour + 1) % 24))]
    return spark.createDataFrame(rows_, "g int, event_ts timestamp_ntz")


def test_hour_spread_is_exact_all_around_the_clock(spark):
    """1,000 groups against every other one; then few, half a day apart, where bins are empty."""
    rng = random.Random(4)
    for hours in (
        [(rng.randrange(24), rng.randrange(1, 9)) for _ in range(1000)],
        [(0, 1), (12, 9), (12, 1), (12, 3)],
        [(23, 1), (11, 1)],
        [(5, 2)],
        [(5, 2), (5, 2), (5, 2)],
    ):
        events = at_hours(spark, hours)
        means = {r.g: r.mean_hour for r in tm.circular_mean_hour(events, "g").collect()}

        def apart(a, b):
            d = abs(a - b) % 24
            return min(d, 24 - d)

        got = {r.g: r.hours_apart for r in tm.hour_spread(events, "g", min_rows=0).collect()}
        distinct = set(means.values())
        expected = {g: max(apart(m, other) for other in distinct) for g, m in means.items()}
        assert got.keys() == expected.keys()
        assert all(got[g] == pytest.approx(expected[g], abs=0.00501) for g in got)


def test_hour_spread_of_groups_without_a_time(make_events):
    events = make_events([{"platform": "web", "event_ts": None}, {"platform": "ios"}, {"platform": None, "event_ts": "22:00:00"}])
    assert rows(tm.hour_spread(events, min_rows=0)) == [("ios", 10.0, 12.0), ("web", None, None), (None, 22.0, 12.0)]
    assert tm.hour_spread(events.limit(0), min_rows=0).count() == 0


def test_a_flat_profile_is_reported(spark, make_events):
    every = [{"event_ts": f"{h:02}:00:00"} for h in range(24)]
    assert rows(tm.hour_profile(make_events(every * 2 + every[:1]))) == [(2, 3)]
    assert rows(tm.flat_hours(make_events(every * 2 + every[:4]))) == [(2, 3)]
    assert rows(tm.flat_hours(make_events(every + every[:1] * 2))) == [(1, 3)]
    assert rows(tm.flat_hours(make_events(every + every[:1] * 3))) == []
    assert rows(tm.flat_hours(make_events(every[:23]))) == []
    assert rows(tm.flat_hours(make_events(every).limit(0))) == [(None, None)]


def test_data_tests_find_what_was_not_planted(planted):
    """The rates of defects and the hours are as they should be; the ladder of steps is another."""
    outcome = {r.name: r.failed_rows for r in tm.run_data_tests(tm.build_models(planted)).collect()}
    wrong = {name for name, failed in outcome.items() if failed}
    assert len(outcome) == 8 and wrong == {"channels_in_order", "step_rates_recovered"}


@pytest.mark.parametrize("gathered", [False, True])
def test_many_groups_are_compared_evenly(spark, gathered):
    """1,500 groups all around the clock, and most of them in two hours half a day apart."""
    rng = random.Random(8)
    hours = [(rng.choice([3, 15] if gathered and i % 10 else range(24)), rng.randrange(1, 9)) for i in range(1500)]
    events = at_hours(spark, hours)
    means = {r.g: r.mean_hour for r in tm.circular_mean_hour(events, "g").collect()}
    pairs = tm.hour_skew(events, "g", min_rows=0, max_hours=11.5)
    expected = 0
    listed = sorted(means.items())
    for i, (_, a) in enumerate(listed):
        for _, b in listed[i + 1 :]:
            d = abs(a - b) % 24
            expected += round(min(d, 24 - d), 2) > 11.5
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sizes = [r["count"] for r in tm.hour_skew(events, "g", min_rows=0, max_hours=11.5).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert pairs.count() == sum(sizes) == expected
    assert len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[1]
