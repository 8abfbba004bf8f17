"""Funnels: how many users ever reached each step, and what the losses are worth.

Every operator first reduces events to one row per user (which steps, how much
revenue). Those are plain bit-ors and sums, so map tasks combine before the shuffle,
no step counts distinct users and no event meets a join.
"""

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.functions.numbers import normal_quantile, ratio


#: Steps per word of bits.
WORD = 62


def _users_by_step(events: DataFrame, steps: Sequence[str], *totals: Column) -> DataFrame:
    """One row per user, the NULL user included: ``done``, a bit per step in as many words as
    there are steps for, and ``totals``. A name that occurs at several places of ``steps`` sets
    the bit of each."""
    words = []
    for first in range(0, len(steps), WORD):
        masks: dict[str, int] = {}
        for bit, step in enumerate(steps[first : first + WORD]):
            masks[step] = masks.get(step, 0) | 1 << bit
        listed = F.create_map(*[F.lit(x) for step, mask in masks.items() for x in (step, mask)])
        words.append(F.bit_or(F.coalesce(F.try_element_at(listed, F.col("event_name")).cast("bigint"), F.lit(0))))
    return events.groupBy("user_id").agg(F.array(*words).alias("done"), *totals)


def _counted(steps: Sequence[str], *values: Column) -> list[Column]:
    """Per value an array with its sum over the known users of each step: a counter per step, read
    off the users' bits in one pass."""
    return [
        F.array(
            *[
                F.sum(F.when((F.getbit(F.col("done")[i // WORD], F.lit(i % WORD)) == 1) & F.col("user_id").isNotNull(), value))
                for i in range(len(steps))
            ]
        )
        for value in values
    ]


def funnel(
    events: DataFrame, steps: Sequence[str] = defaults.STEPS, goal: str = defaults.GOAL
) -> DataFrame:
    """Per step: users, previous step's users, conversions, users lost, recoverable revenue.

    A step counts the users who ever did it, in any order, any number of steps and a name at
    several places included; a step nobody did is left out and the next one compares with the
    nearest step present. Recoverable revenue is
    users lost times revenue per user who reached ``goal``, NULL when nobody did.
    """
    per_user = _users_by_step(events, steps, F.sum("revenue").alias("user_revenue"))
    # One row, however many users: a counter and a sum per step.
    reached, paid = _counted(steps, F.lit(1), F.col("user_revenue"))
    anyone = F.array(*[F.count_if(F.getbit(F.col("done")[i // WORD], F.lit(i % WORD)) == 1) for i in range(len(steps))])
    sums = per_user.agg(F.struct(reached.alias("reached"), paid.alias("paid"), anyone.alias("anyone")).alias("sums")).scalar()
    names = F.array(*[F.lit(step) for step in steps])
    place = F.col("id").cast("int")
    totals = (
        events.sparkSession.range(len(steps), numPartitions=1)
        .select(place.alias("place"), F.get(names, place).alias("step"), sums.alias("sums"))
        .select(
            (F.col("place") + 1).alias("step_index"),
            "step",
            # NULL for a step nobody did, which the windows below pass over.
            F.when(F.get("sums.anyone", F.col("place")) > 0, F.coalesce(F.get("sums.reached", F.col("place")), F.lit(0))).alias("users_reached"),
            F.get("sums.paid", F.col("place")).alias("paid"),
        )
    )
    in_order = Window.orderBy("step_index")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    users = F.col("users_reached")
    previous = F.last("users_reached", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("users_reached", ignorenulls=True).over(whole)
    per_goal_user = F.max(F.when(F.col("step") == goal, ratio(F.coalesce("paid", F.lit(0)), users)))
    return (
        totals.select("*", previous.alias("users_previous_step"), first.alias("first"), per_goal_user.over(whole).alias("per_goal"))
        .filter(users.isNotNull())
        .withColumn("users_lost", F.col("users_previous_step") - users)
        .select(
            "step_index",
            "step",
            "users_reached",
            "users_previous_step",
            ratio(users, F.col("users_previous_step"), 4).alias("step_conversion"),
            ratio(users, F.col("first"), 4).alias("cumulative_conversion"),
            "users_lost",
            F.round(F.col("users_lost") * F.col("per_goal"), 2).alias("max_recoverable_revenue"),
        )
        .orderBy("step_index")
    )


def funnel_by(
    events: DataFrame,
    users: DataFrame,
    by: str = "channel",
    steps: Sequence[str] = defaults.STEPS,
) -> DataFrame:
    """Per segment and step: users and the share of the segment's previous step."""
    per_user = _users_by_step(events.filter(F.col("event_name").isin(*steps)), steps)
    (reached,) = _counted(steps, F.lit(1))
    counted = per_user.join(users.select("user_id", by), "user_id").groupBy(by).agg(reached.alias("reached"))
    # A segment is one row here, with a number per step.
    names = F.array(*[F.lit(step) for step in steps])
    in_segment = Window.partitionBy(by).orderBy("step_index")
    users_reached = F.col("users_reached")
    return (
        counted.select(by, F.posexplode("reached").alias("place", "users_reached"))
        .filter("users_reached > 0")
        .select(by, (F.col("place") + 1).alias("step_index"), F.get(names, F.col("place")).alias("step"), "users_reached")
        .withColumn(
            "step_conversion", ratio(users_reached, F.lag("users_reached").over(in_segment))
        )
    )


def step_user_counts(events: DataFrame, steps: Sequence[str] = defaults.STEPS) -> DataFrame:
    """Distinct users per step name; a name listed twice is one row."""
    done = events.filter(F.col("event_name").isin(*steps)).select("event_name", "user_id").distinct()
    return done.groupBy("event_name").agg(F.count("user_id").alias("users"))


def worst_step(funnel: DataFrame) -> DataFrame:
    """The step that loses most users against its predecessor, the earlier one on a tie."""
    return (
        funnel.filter(F.col("users_previous_step").isNotNull())
        .orderBy(F.col("users_lost").desc(), "step_index")
        .limit(1)
    )


def arpu(events: DataFrame, goal: str = defaults.GOAL) -> DataFrame:
    """Revenue per user among the users who ever reached ``goal``, as one row."""
    known = events.filter(F.col("user_id").isNotNull())
    per_user = _users_by_step(known, [goal], F.sum("revenue").alias("user_revenue"))
    return (
        per_user.filter("done[0] = 1")
        .agg(F.sum("user_revenue").alias("revenue"), F.count("*").alias("users"))
        .select(ratio(F.col("revenue"), F.col("users")).alias("arpu_per_purchaser"))
    )


def opportunity(
    funnel: DataFrame,
    events: DataFrame,
    goal: str = defaults.GOAL,
    scenarios: Mapping[str, float] = defaults.SCENARIOS,
) -> DataFrame:
    """One row per scenario: users won back at the worst step and what they would bring.

    They are assumed to convert like users who passed that step, so it is an upper bound.
    """
    worst = F.struct("users_lost", -F.col("step_index"), "step", "users_reached", "step_conversion")
    summary = funnel.agg(
        F.max(F.when(F.col("users_previous_step").isNotNull(), worst)).alias("worst"),
        F.max_by("users_reached", "step_index").alias("last_users"),
    ).select(
        F.col("worst.step").alias("worst_step"),
        F.col("worst.users_lost").alias("users_lost_at_worst_step"),
        F.col("worst.step_conversion").alias("step_conversion"),
        arpu(events, goal).scalar().alias("arpu_per_purchaser"),
        ratio(F.col("last_users"), F.col("worst.users_reached")).alias("downstream_purchase_rate"),
    )
    rates = F.array(
        *[
            F.struct(F.lit(name).alias("scenario"), F.lit(rate).alias("recovery_rate_assumed"))
            for name, rate in scenarios.items()
        ]
    )
    recovered = F.col("users_lost_at_worst_step") * F.col("recovery_rate_assumed")
    converted = recovered * F.col("downstream_purchase_rate")
    return summary.select("*", F.inline(rates)).select(
        "scenario",
        "recovery_rate_assumed",
        F.bround(recovered, 0).cast("bigint").alias("users_recovered"),
        F.bround(converted, 0).cast("bigint").alias("incremental_purchasers"),
        F.bround(converted * F.col("arpu_per_purchaser"), 2).alias("incremental_revenue"),
        "worst_step",
        "users_lost_at_worst_step",
        "step_conversion",
        "arpu_per_purchaser",
        "downstream_purchase_rate",
    )


def detectable_effect(
    funnel: DataFrame,
    per_arm: int,
    power: float = defaults.POWER,
    alpha: float = defaults.ALPHA,
) -> DataFrame:
    """Per step, the smallest change in its conversion an A/B test of this size detects."""
    reach = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    base: Column = F.col("step_conversion")
    absolute = reach * F.sqrt(2 * base * (1 - base)) / sqrt(per_arm)
    return funnel.filter(base.isNotNull()).select(
        "step_index",
        "step",
        "step_conversion",
        absolute.alias("detectable_absolute"),
        ratio(absolute, base).alias("detectable_relative"),
    )
