"""Retention by cohort, by segment and by day.

Events are reduced to the days each user was active on (``active_days``) before they meet the
users: one row per user and 64 days, a bit per day. Each report also takes that activity itself, which
can be kept and extended (``extend_activity``) instead of reading all events again. ``users`` holds one
row per user, as ``first_touch_users`` returns.
"""

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.functions.numbers import ratio
from tidemark.operators.activity import active_days, active_on


def retention(
    events: DataFrame,
    users: DataFrame,
    by: Sequence[str] = ("signup_date", "channel"),
    exact: Sequence[int] = defaults.EXACT_DAYS,
    plus: Sequence[int] = defaults.PLUS_DAYS,
    rates: Sequence[str] = tuple(defaults.RETENTION_RATES),
) -> DataFrame:
    """Per cohort: its users, those active on exactly day N, and those active on day N or later.

    ``rates`` names the counts also given as a share of the cohort. A cohort with a NULL
    in ``by`` keeps its size and shows no activity.
    """
    return retention_of(active_days(events), users, by, exact, plus, rates)


def retention_of(
    activity: DataFrame,
    users: DataFrame,
    by: Sequence[str] = ("signup_date", "channel"),
    exact: Sequence[int] = defaults.EXACT_DAYS,
    plus: Sequence[int] = defaults.PLUS_DAYS,
    rates: Sequence[str] = tuple(defaults.RETENTION_RATES),
) -> DataFrame:
    """``retention`` from the activity of the events."""
    keys = dict.fromkeys(["user_id", "signup_date", *by])
    words = users.select(*keys).join(activity, "user_id", "left")
    active = words.groupBy(*keys).agg(
        F.max("last_day").alias("last_day"), *[F.max(active_on(F.col("signup_date"), n)).alias(f"on_{n}") for n in exact]
    )
    named = reduce(Column.__and__, [F.col(column).isNotNull() for column in by], F.lit(True))
    counts = active.groupBy(*by).agg(
        F.count("user_id").alias("cohort_users"),
        *[F.count_if(named & F.col(f"on_{n}")).alias(f"d{n}_exact") for n in exact],
        *[F.count_if(named & (F.col("last_day") >= F.date_add("signup_date", n))).alias(f"d{n}_plus") for n in plus],
    )
    shares = [ratio(F.col(c), F.col("cohort_users"), 4).alias(f"{c}_rate") for c in rates]
    return counts.select("*", *shares).orderBy(*[F.col(c).asc_nulls_last() for c in by])


def retention_by_segment(
    retention: DataFrame,
    events: DataFrame,
    by: str = "channel",
    rates: Mapping[str, int] = defaults.RETENTION_RATES,
    eligible: Sequence[int] = defaults.ELIGIBLE_DAYS,
) -> DataFrame:
    """Cohorts rolled up to a segment, each horizon over the cohorts old enough for it.

    A cohort counts for day N when it signed up at least N days before the last event.
    ``rates`` maps a count of ``retention`` to its day; ``eligible`` lists the days whose
    denominators are shown.
    """
    last_date = events.agg(F.max(F.to_date("event_ts"))).scalar()
    aged = retention.withColumn("age", F.datediff(last_date, "signup_date"))

    def old_enough(column: str, day: int) -> Column:
        return F.sum(F.when(F.col("age") >= day, F.col(column)))

    rolled = aged.groupBy(by).agg(
        F.sum("cohort_users").alias("users_all_cohorts"),
        *[old_enough("cohort_users", n).alias(f"eligible_d{n}") for n in eligible],
        *[
            ratio(old_enough(c, n), old_enough("cohort_users", n), 4).alias(f"{c}_rate")
            for c, n in rates.items()
        ],
    )
    leading = "d7_plus" if "d7_plus" in rates else next(iter(rates))
    return rolled.orderBy(F.col(f"{leading}_rate").desc_nulls_last(), by)


def pooled_retention(
    retention: DataFrame, by: str = "channel", count: str = "d7_plus"
) -> DataFrame:
    """A count over all cohorts of a segment as a share of all their users."""
    rate = ratio(F.sum(count), F.sum("cohort_users"))
    return retention.groupBy(by).agg(rate.alias(f"{count}_rate"))


def week_one_dropoff(
    events: DataFrame,
    users: DataFrame,
    days: int = defaults.WEEK_ONE_DAYS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Users, those last seen before day ``days``, and their share; per ``by`` if given."""
    last = events.groupBy("user_id").agg(F.max(F.to_date("event_ts")).alias("active_date"))
    activity = users.join(last, "user_id").withColumn(
        "last_day", F.datediff("active_date", "signup_date")
    )
    lost = F.count_if(F.col("last_day") < days)
    return activity.groupBy(*by).agg(
        F.count("*").alias("users"),
        lost.alias("lost_in_week_one"),
        ratio(lost, F.count("*"), 4).alias("week_one_loss_rate"),
    )


def retention_curve(
    events: DataFrame,
    users: DataFrame,
    by: str = "channel",
    max_day: int = defaults.CURVE_DAYS,
) -> DataFrame:
    """Share of each segment active on each day 0..``max_day`` after signup."""
    return retention_curve_of(active_days(events), users, by, max_day)


def retention_curve_of(
    activity: DataFrame,
    users: DataFrame,
    by: str = "channel",
    max_day: int = defaults.CURVE_DAYS,
) -> DataFrame:
    """``retention_curve`` from the activity of the events. A day lies in one word of a user, so
    its users are counted on the words, a counter per day; days nobody was active on are left out."""
    signed_up = users.select("user_id", "signup_date", by)
    on = [F.count_if(active_on(F.col("signup_date"), n)) for n in range(max_day + 1)]
    active = (
        signed_up.filter(F.col(by).isNotNull())
        .join(activity, "user_id")
        .groupBy(by)
        .agg(F.array(*on).alias("active"))
        .select(by, F.posexplode("active").alias("day_number", "active"))
        .filter("active > 0")
    )
    sizes = users.groupBy(by).agg(F.count("*").alias("size"))
    return (
        active.join(sizes, by)
        .select(by, "day_number", ratio(F.col("active"), F.col("size")).alias("rate"))
        .orderBy(by, "day_number")
    )
