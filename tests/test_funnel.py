import random
from datetime import timedelta

import pytest
from conftest import at, rows

import tidemark as tm
from tidemark import defaults

STEPS = defaults.STEPS


def ladder(user, depth, channel="organic", revenue=0.0):
    """The first ``depth`` steps of one user, a minute apart; the last purchase pays."""
    return [
        {
            "user_id": user,
            "event_name": step,
            "event_ts": at("10:00:00") + timedelta(minutes=i),
            "channel": channel,
            "revenue": revenue if step == "purchase" else 0.0,
        }
        for i, step in enumerate(STEPS[:depth])
    ]


@pytest.fixture(scope="module")
def narrowing(make_events):
    depths = [5, 5, 4, 3, 3, 3, 2, 1]
    return make_events([e for i, d in enumerate(depths) for e in ladder(f"u{i}", d, revenue=10.0 * (i + 1))])


def test_funnel(narrowing):
    assert [tuple(r) for r in tm.funnel(narrowing).collect()] == [
        (1, "signup", 8, None, None, 1.0, None, None),
        (2, "activate", 7, 8, 0.875, 0.875, 1, 15.0),
        (3, "first_search", 6, 7, 0.8571, 0.75, 1, 15.0),
        (4, "add_to_cart", 3, 6, 0.5, 0.375, 3, 45.0),
        (5, "purchase", 2, 3, 0.6667, 0.25, 1, 15.0),
    ]


def test_worst_step(narrowing):
    assert tm.worst_step(tm.funnel(narrowing)).first().step == "add_to_cart"


def test_worst_step_tie_goes_to_the_earlier(make_events):
    events = make_events(ladder("a", 5) + ladder("b", 2) + ladder("c", 1))
    assert tm.worst_step(tm.funnel(events)).first().step == "activate"


def test_steps_count_in_any_order_and_once(make_events):
    events = make_events(
        [
            {"event_name": "purchase", "event_ts": "09:00:00", "revenue": 4.0},
            {"event_name": "purchase", "event_ts": "09:30:00", "revenue": 6.0},
            {"event_name": "signup"},
            {"event_name": "signup", "event_ts": "12:00:00"},
            {"event_name": "signup", "user_id": "u2"},
        ]
    )
    assert rows(tm.funnel(events), "step", "users_reached", "max_recoverable_revenue") == [
        ("purchase", 1, 10.0),
        ("signup", 2, None),
    ]


def test_missing_middle_step_compares_with_the_nearest(make_events):
    events = make_events([e for e in ladder("a", 5) + ladder("b", 2) if e["event_name"] != "first_search"])
    steps = {r.step: r for r in tm.funnel(events).collect()}
    assert "first_search" not in steps
    assert (steps["add_to_cart"].step_index, steps["add_to_cart"].users_previous_step) == (4, 2)


def test_no_purchase_leaves_the_value_open(make_events):
    events = make_events(ladder("a", 4) + ladder("b", 1))
    assert {r.max_recoverable_revenue for r in tm.funnel(events).collect()} == {None}
    assert tm.arpu(events).first()[0] is None


def test_events_without_a_user_make_a_step_occur_but_do_not_count(make_events):
    events = make_events(ladder("a", 1) + [{"user_id": None, "event_name": "activate", "revenue": 9.0}])
    assert rows(tm.funnel(events), "step", "users_reached", "step_conversion") == [
        ("activate", 0, 0.0),
        ("signup", 1, None),
    ]


def test_other_steps_and_goal(make_events):
    events = make_events(ladder("a", 5, revenue=8.0) + ladder("b", 3))
    steps = tm.funnel(events, steps=["first_search", "purchase"], goal="purchase")
    assert rows(steps, "step_index", "step", "users_reached", "max_recoverable_revenue") == [
        (1, "first_search", 2, None),
        (2, "purchase", 1, 8.0),
    ]


def test_arpu_spreads_all_revenue_of_buyers(make_events):
    extra = [{"user_id": "a", "revenue": 5.0}, {"user_id": "b", "revenue": 100.0}]
    events = make_events(ladder("a", 5, revenue=20.0) + ladder("b", 2) + ladder("c", 5, revenue=3.0) + extra)
    assert tm.arpu(events).first().arpu_per_purchaser == 14.0


def test_recoverable_revenue_per_lost_user_is_the_arpu(narrowing):
    step = tm.funnel(narrowing).filter("step = 'add_to_cart'").first()
    assert step.max_recoverable_revenue / step.users_lost == tm.arpu(narrowing).first()[0]


def test_opportunity(narrowing):
    sized = {r.scenario: r for r in tm.opportunity(tm.funnel(narrowing), narrowing).collect()}
    assert set(sized) == {"conservative", "central", "optimistic"}
    best = sized["optimistic"]
    assert (best.worst_step, best.users_lost_at_worst_step) == ("add_to_cart", 3)
    assert best.downstream_purchase_rate == 2 / 3
    assert (best.users_recovered, best.incremental_purchasers) == (1, 0)
    assert best.incremental_revenue == 6.0


def test_opportunity_rounds_half_to_even(make_events):
    events = make_events([e for i in range(50) for e in ladder(f"u{i}", 1)] + ladder("x", 5, revenue=2.0))
    halves = tm.opportunity(tm.funnel(events), events, scenarios={"low": 0.05, "high": 0.07})
    assert rows(halves, "scenario", "users_recovered") == [("high", 4), ("low", 2)]


def test_published_scenarios(spark):
    """Sizes printed with the published analysis follow from its funnel and ARPU."""
    funnel = spark.createDataFrame(
        [
            (3, "first_search", 37232, 43731, 0.8514, 6499),
            (4, "add_to_cart", 18568, 37232, 0.4987, 18664),
            (5, "purchase", 11877, 18568, 0.6396, 6691),
        ],
        "step_index int, step string, users_reached bigint, users_previous_step bigint, "
        "step_conversion double, users_lost bigint",
    )
    buyer = spark.createDataFrame(
        [("u", "purchase", 41.583939313216796)], "user_id string, event_name string, revenue double"
    )
    columns = "scenario users_recovered incremental_purchasers incremental_revenue"
    assert rows(tm.opportunity(funnel, buyer), *columns.split()) == [
        ("central", 1866, 1194, 49644.6),
        ("conservative", 933, 597, 24822.3),
        ("optimistic", 3733, 2388, 99289.19),
    ]
    effect = {r.step: r for r in tm.detectable_effect(funnel, 18_500).collect()}["add_to_cart"]
    assert 0.028 < effect.detectable_relative < 0.031


def test_funnel_by_segment(make_events):
    events = make_events(
        ladder("a", 3, "organic") + ladder("b", 1, "organic") + ladder("c", 1, "email") + ladder("d", 2, None)
    )
    by_channel = tm.funnel_by(events, tm.first_touch_users(events))
    assert rows(by_channel, "channel", "step_index", "users_reached", "step_conversion") == [
        ("email", 1, 1, None),
        ("organic", 1, 2, None),
        ("organic", 2, 1, 0.5),
        ("organic", 3, 1, 1.0),
        (None, 1, 1, None),
        (None, 2, 1, 1.0),
    ]


def test_random_events_match_brute_force(make_events):
    """One user has a third of the events."""
    rng = random.Random(3)
    names = (*defaults.EVENT_NAMES, "other", None)
    events = [
        {
            "user_id": "hot" if i % 3 == 0 else rng.choice([f"u{n}" for n in range(60)] + [None]),
            "event_name": rng.choice(names),
            "event_ts": at("10:00:00") + timedelta(seconds=i),
            "revenue": float(rng.randrange(4)),
        }
        for i in range(600)
    ]
    reached = {s: {e["user_id"] for e in events if e["event_name"] == s} - {None} for s in STEPS}
    buyers = reached["purchase"]
    paid = sum(e["revenue"] for e in events if e["user_id"] in buyers)
    table = make_events(events)
    got = {r.step: r for r in tm.funnel(table).collect()}
    for before, step in zip((None, *STEPS), STEPS):
        assert got[step].users_reached == len(reached[step])
        if before:
            lost = len(reached[before]) - len(reached[step])
            assert got[step].users_lost == lost
            assert got[step].max_recoverable_revenue == pytest.approx(lost * paid / len(buyers), abs=0.006)
    assert rows(tm.step_user_counts(table)) == sorted((s, len(u)) for s, u in reached.items())


@pytest.mark.parametrize("count", [62, 63, 64, 65, 200])
def test_any_number_of_steps(make_events, count):
    steps = [f"s{i}" for i in range(count)]
    events = make_events(
        [{"user_id": f"u{i}", "event_name": s} for i in range(3) for s in steps[: count - i * 30]]
    )
    expected = [sum(j < count - i * 30 for i in range(3)) for j in range(count)]
    funnel = tm.funnel(events, steps=steps, goal=steps[-1]).collect()
    assert [(r.step_index, r.step, r.users_reached) for r in funnel] == [
        (j + 1, steps[j], n) for j, n in enumerate(expected)
    ]
    counts = {r.event_name: r.users for r in tm.step_user_counts(events, steps).collect()}
    assert counts == dict(zip(steps, expected))
    by = tm.funnel_by(events, tm.first_touch_users(events), steps=steps).collect()
    assert sorted((r.step_index, r.users_reached) for r in by) == list(enumerate(expected, 1))


def test_a_repeated_step_counts_at_both_places(make_events):
    events = make_events(ladder("a", 3) + ladder("b", 2))
    steps = ["signup", "activate", "signup", "first_search"]
    got = [(r.step_index, r.step, r.users_reached) for r in tm.funnel(events, steps=steps).collect()]
    assert got == [(1, "signup", 2), (2, "activate", 2), (3, "signup", 2), (4, "first_search", 1)]
    assert rows(tm.step_user_counts(events, steps)) == [("activate", 2), ("first_search", 1), ("signup", 2)]


@pytest.mark.parametrize("n", [5, 100])
def test_users_are_not_multiplied_by_steps(make_events, spark, n):
    steps = [f"s{i}" for i in range(n)]
    events = make_events([{"user_id": f"u{i % 7}", "event_name": f"s{i}", "revenue": 1.0} for i in range(n)])
    plan = tm.funnel(events, steps=steps)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    got = tm.funnel(events, steps=steps, goal=steps[-1]).collect()
    assert [(r.step_index, r.step, r.users_reached) for r in got] == [(i + 1, s, 1) for i, s in enumerate(steps)]


def test_no_events_and_no_known_user(make_events):
    assert tm.funnel(make_events([{}]).limit(0)).count() == 0
    unknown = make_events([{"user_id": None, "event_name": "signup", "revenue": 3.0}])
    (row,) = tm.funnel(unknown).collect()
    assert (row.step, row.users_reached, row.max_recoverable_revenue) == ("signup", 0, None)
