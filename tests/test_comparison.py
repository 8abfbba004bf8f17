from math import erfc, sqrt

import pytest
from pyspark.sql import functions as F

import tidemark as tm
from tidemark.functions.numbers import normal_quantile, normal_upper_tail


def groups(spark, sizes):
    """Users and purchases with the given (members, buyers) per channel."""
    users = events = None
    for channel, (members, buyers) in sizes.items():
        ids = spark.range(members).select(
            F.concat(F.lit(channel), F.col("id").cast("string")).alias("user_id"), "id"
        )
        part = ids.select("user_id", F.lit(channel).alias("channel"))
        bought = ids.filter(F.col("id") < buyers).select("user_id", F.lit("purchase").alias("event_name"))
        users = part if users is None else users.unionByName(part)
        events = bought if events is None else events.unionByName(bought)
    return users, events


def test_published_comparison(spark):
    """Counts whose difference, interval and p-value were published."""
    users, events = groups(spark, {"organic": (20245, 6042), "paid_search": (15700, 923), "email": (50, 50)})
    row = tm.two_proportion_test(users, events.unionByName(events)).first()
    assert (row.n_organic, row.n_paid_search) == (20245, 15700)
    assert row.organic_rate == pytest.approx(0.29844406026179304, abs=1e-15)
    assert row.paid_search_rate == pytest.approx(0.05878980891719745, abs=1e-15)
    assert row.absolute_difference == pytest.approx(-0.2396542513445956, abs=1e-15)
    assert row.relative_difference == pytest.approx(-0.8030123003097216, abs=1e-14)
    assert row.ci_low == pytest.approx(-0.2469527163862234, abs=1e-14)
    assert row.ci_high == pytest.approx(-0.23235578630296777, abs=1e-14)
    assert row.p_value == 0.0


def test_p_value_uses_the_pooled_error(spark):
    users, events = groups(spark, {"a": (200, 60), "b": (150, 60)})
    row = tm.two_proportion_test(users, events, a="a", b="b").first()
    pooled = 120 / 350
    z = (0.4 - 0.3) / sqrt(pooled * (1 - pooled) * (1 / 200 + 1 / 150))
    assert row.z == pytest.approx(z, rel=1e-12)
    assert row.p_value == pytest.approx(erfc(z / sqrt(2)), rel=1e-12)


def test_confidence_level(spark):
    users, events = groups(spark, {"a": (200, 60), "b": (150, 60)})
    wide = tm.two_proportion_test(users, events, a="a", b="b", alpha=0.01).first()
    narrow = tm.two_proportion_test(users, events, a="a", b="b").first()
    ratio = (wide.ci_high - wide.ci_low) / (narrow.ci_high - narrow.ci_low)
    assert ratio == pytest.approx(normal_quantile(0.995) / normal_quantile(0.975))


def test_missing_segment_gives_nulls(spark):
    users, events = groups(spark, {"organic": (10, 5)})
    row = tm.two_proportion_test(users, events).first()
    assert (row.n_paid_search, row.paid_search_rate, row.p_value, row.ci_low) == (0, None, None, None)


def test_nobody_converts(spark):
    users, events = groups(spark, {"organic": (10, 0), "paid_search": (10, 0)})
    row = tm.two_proportion_test(users, events).first()
    assert (row.absolute_difference, row.relative_difference, row.p_value) == (0.0, None, None)


def test_upper_tail_matches_erfc(spark):
    values = [-8.0, -3.0, -0.5, 0.0, 1e-9, 0.3, 1.0, 1.96, 2.9, 2.999, 3.0, 3.001, 4.5, 8.0, 20.0, 37.0, 60.0]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "z double")
    got = table.select("z", normal_upper_tail(F.col("z")).alias("p")).collect()
    for z, p in got:
        if z is None:
            assert p is None
        else:
            assert p == pytest.approx(0.5 * erfc(z / sqrt(2)), rel=1e-12, abs=0)
