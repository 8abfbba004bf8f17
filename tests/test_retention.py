import random
from datetime import date, datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

import tidemark as tm

DAY0 = datetime(2026, 3, 2, 12)


def visits(user, days, channel="organic", start=0):
    return [
        {"user_id": user, "event_ts": DAY0 + timedelta(days=start + d), "channel": channel} for d in days
    ]


def cohorts(events):
    users = tm.first_touch_users(events)
    return tm.retention(events, users), users


def test_exact_and_plus_days(make_events):
    events = make_events(visits("a", [0, 1, 1, 7]) + visits("b", [0, 8]) + visits("c", [0]) + visits("d", [0, 30]))
    table, _ = cohorts(events)
    row = table.first().asDict()
    assert row["cohort_users"] == 4
    assert (row["d1_exact"], row["d7_exact"]) == (1, 1)
    assert (row["d1_plus"], row["d7_plus"], row["d30_plus"]) == (3, 3, 1)
    assert (row["d1_exact_rate"], row["d7_plus_rate"], row["d30_plus_rate"]) == (0.25, 0.75, 0.25)
    assert list(row) == (
        "signup_date channel cohort_users d1_exact d7_exact d1_plus d7_plus d30_plus "
        "d1_exact_rate d7_plus_rate d30_plus_rate"
    ).split()


def test_null_channel_cohort_keeps_its_size_without_activity(make_events):
    table, _ = cohorts(make_events(visits("a", [0, 1, 7], channel=None)))
    row = table.first()
    assert (row.cohort_users, row.d1_exact, row.d1_plus, row.d7_plus) == (1, 0, 0, 0)


def test_user_without_activity_counts_in_the_cohort(make_events):
    events = make_events(visits("a", [0, 1]) + visits("b", [0]))
    users = tm.first_touch_users(events)
    assert rows(tm.retention(events.filter("user_id = 'a'"), users), "cohort_users", "d1_plus") == [(2, 1)]


def test_activity_before_signup_is_not_retention(make_events):
    events = make_events(visits("a", [0, 3]))
    users = tm.first_touch_users(events.filter(f"event_ts > '{DAY0 + timedelta(days=1)}'"))
    table = tm.retention(events, users, exact=[0], plus=[0, 1], rates=[])
    assert rows(table, "d0_exact", "d0_plus", "d1_plus") == [(1, 1, 0)]


def test_null_user_leaves_an_empty_cohort(make_events):
    table, _ = cohorts(make_events([{"user_id": None, "event_ts": DAY0}]))
    row = table.first()
    assert (row.cohort_users, row.d1_exact_rate) == (0, None)


def test_other_keys_and_horizons(make_events):
    events = make_events(visits("a", [0, 3]) + visits("b", [0], start=1))
    table = tm.retention(
        events, tm.first_touch_users(events), by=["platform"], exact=[3], plus=[2], rates=["d3_exact"]
    )
    assert rows(table) == [("web", 2, 1, 1, 0.5)]


def test_young_cohorts_leave_the_denominator_of_their_horizon(make_events):
    events = make_events(
        visits("old", [0, 1, 9, 31]) + visits("mid", [0], start=20) + visits("young", [0], start=28)
    )
    table, _ = cohorts(events)
    row = tm.retention_by_segment(table, events).first()
    assert (row.users_all_cohorts, row.eligible_d1, row.eligible_d30) == (3, 3, 1)
    assert (row.d1_exact_rate, row.d7_plus_rate, row.d30_plus_rate) == (0.3333, 0.5, 1.0)


def test_segments_come_best_first(make_events):
    events = make_events(
        visits("a", [0, 8], "email") + visits("b", [0], "organic") + visits("c", [0, 7], "organic")
    )
    table, _ = cohorts(events)
    assert [r.channel for r in tm.retention_by_segment(table, events).collect()] == ["email", "organic"]
    assert rows(tm.pooled_retention(table)) == [("email", 1.0), ("organic", 0.5)]


def test_a_segment_too_young_has_no_rate(make_events):
    events = make_events(visits("a", [0, 8], "email") + visits("b", [0], "organic", start=8))
    table, _ = cohorts(events)
    row = tm.retention_by_segment(table, events).filter("channel = 'organic'").first()
    assert (row.eligible_d1, row.d1_exact_rate, row.d7_plus_rate) == (None, None, None)


def test_week_one_dropoff(make_events):
    events = make_events(visits("a", [0, 6]) + visits("b", [0, 7], "email") + visits("c", [0, 1, 30]))
    users = tm.first_touch_users(events)
    assert rows(tm.week_one_dropoff(events, users)) == [(3, 1, 0.3333)]
    assert rows(tm.week_one_dropoff(events, users, by=["channel"])) == [
        ("email", 1, 0, 0.0),
        ("organic", 2, 1, 0.5),
    ]
    assert rows(tm.week_one_dropoff(events, users, days=8), "lost_in_week_one") == [(2,)]


def test_week_one_without_users(make_events):
    events = make_events([]).limit(0)
    assert rows(tm.week_one_dropoff(events, tm.first_touch_users(events))) == [(0, 0, None)]


def test_retention_curve(make_events):
    events = make_events(visits("a", [0, 0, 2, 31]) + visits("b", [0]) + visits("c", [0], None))
    curve = tm.retention_curve(events, tm.first_touch_users(events))
    assert [tuple(r) for r in curve.collect()] == [("organic", 0, 1.0), ("organic", 2, 0.5)]


def test_random_visits_match_brute_force(make_events):
    """One user has a third of the events."""
    rng = random.Random(5)
    events = []
    for i in range(900):
        user = "hot" if i % 3 == 0 else f"u{rng.randrange(80)}"
        moment = DAY0 + timedelta(days=rng.randrange(40), minutes=rng.randrange(600))
        channel = rng.choice(["organic", "email", None])
        events.append({"user_id": user, "event_ts": moment, "channel": channel})
    first, days = {}, {}
    for i, e in enumerate(events):
        key = (e["event_ts"], i)
        if e["user_id"] not in first or key < first[e["user_id"]][0]:
            first[e["user_id"]] = (key, e["event_ts"].date(), e["channel"])
        days.setdefault(e["user_id"], set()).add(e["event_ts"].date())
    expected = {}
    for user, (_, signup, channel) in first.items():
        numbers = {(d - signup).days for d in days[user]} if channel else set()
        row = expected.setdefault((signup, channel), [0] * 6)
        for j, hit in enumerate(
            [True, 1 in numbers, 7 in numbers, *[any(n >= h for n in numbers) for h in (1, 7, 30)]]
        ):
            row[j] += hit
    table, _ = cohorts(make_events(events))
    got = {(r.signup_date, r.channel): list(r[2:8]) for r in table.collect()}
    assert got == expected


@pytest.mark.parametrize("ts", ["timestamp_ntz", "timestamp"])
def test_days_follow_calendar_dates(make_events, ts):
    events = make_events(
        [{"event_ts": "2026-03-02 23:59:59"}, {"event_ts": "2026-03-03 00:00:01"}], ts
    )
    table, _ = cohorts(events)
    assert rows(table, "signup_date", "d1_exact") == [(date(2026, 3, 2), 1)]


def month(make_events, n=400, seed=3):
    """Events of 30 days, some before 1970 and some far later, with a hot user and a NULL one."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 20)
    found = []
    for i in range(n):
        user = rng.choice(["hot", "hot", None, *[f"u{j}" for j in range(25)]])
        day = start + timedelta(days=rng.randrange(30), hours=rng.randrange(24))
        found.append({"user_id": user, "event_ts": day, "channel": rng.choice(["email", "social", None])})
    found += [{"user_id": "old", "event_ts": datetime(1969, 12, 30)}, {"user_id": "old", "event_ts": datetime(1970, 1, 6)}]
    found += [{"user_id": "u1", "event_ts": None}, {"user_id": "undated", "event_ts": None}]
    return make_events(found)


def test_the_activity_of_parts_adds_up_to_that_of_all(make_events, spark, tmp_path):
    """First 20 days and 10 more, an overlap, and one day at a time, against all 30 at once."""
    events, path = month(make_events), f"{tmp_path}/activity"
    users = tm.first_touch_users(events.filter("event_ts is not null"))
    day = F.to_date("event_ts")
    first, last = events.filter(day < "2026-02-09"), events.filter((day >= "2026-02-09") | day.isNull())
    whole = tm.active_days(events)
    assert rows(tm.merge_activity(tm.active_days(first), tm.active_days(last))) == rows(whole)
    assert rows(tm.merge_activity(whole, tm.active_days(first), tm.active_days(first))) == rows(whole)
    for only in [r.d for r in events.select(day.alias("d")).distinct().collect()]:
        grown = tm.extend_activity(spark, path, events.filter(day.eqNullSafe(F.lit(only))))
    assert rows(grown) == rows(tm.open_table(spark, path)) == rows(whole)
    options = {"exact": (0, 1, 7, 64), "plus": (0, 1, 7, 20, 30), "rates": ()}
    assert rows(tm.retention_of(grown, users, **options)) == rows(tm.retention(events, users, **options))
    assert rows(tm.retention_curve_of(grown, users, max_day=70)) == rows(tm.retention_curve(events, users, max_day=70))
    again = tm.extend_activity(spark, path, first)
    assert rows(again) == rows(whole)


def test_retention_by_brute_force(make_events):
    events = month(make_events, 700, 5)
    users = tm.first_touch_users(events.filter("event_ts is not null"))
    active = {}
    for r in events.filter("event_ts is not null").collect():
        active.setdefault(r.user_id, set()).add(r.event_ts.date())
    expected = {}
    for u in users.collect():
        size = expected.setdefault((u.signup_date, u.channel), [0] * 6)
        size[0] += u.user_id is not None
        if u.channel is not None and u.user_id is not None:
            ages = {(d - u.signup_date).days for d in active[u.user_id]}
            for i, hit in enumerate((1 in ages, 7 in ages, max(ages) >= 1, max(ages) >= 7, max(ages) >= 30), 1):
                size[i] += hit
    columns = "cohort_users d1_exact d7_exact d1_plus d7_plus d30_plus".split()
    got = {(r.signup_date, r.channel): [r[c] for c in columns] for r in tm.retention(events, users).collect()}
    assert got == expected
    curve = {(r.channel, r.day_number): r.rate for r in tm.retention_curve(events, users).collect()}
    sizes, seen = {}, {}
    for u in users.collect():
        sizes[u.channel] = sizes.get(u.channel, 0) + 1
        for d in active[u.user_id] if u.user_id is not None else ():
            age = (d - u.signup_date).days
            if age <= 30:
                seen[u.channel, age] = seen.get((u.channel, age), 0) + 1
    assert curve == {(c, d): pytest.approx(n / sizes[c]) for (c, d), n in seen.items() if c is not None}


def test_activity_is_a_row_per_user_and_64_days(make_events):
    events = make_events([{"event_ts": datetime(2026, 1, 1) + timedelta(days=i % 40, minutes=i)} for i in range(500)])
    assert 1 <= tm.active_days(events).count() <= 2
    plan = tm.active_days(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
