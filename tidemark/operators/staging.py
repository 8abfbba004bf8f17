"""Cleaning raw events and fixing each user's first touch."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.functions.times import monday_of


def _corrected(ts: str, platform: str, shifts: Mapping[str, float]) -> Column:
    corrected = F.col(ts)
    for name, hours in shifts.items():
        moved = F.col(ts) + F.make_dt_interval(mins=F.lit(round(hours * 60)))
        corrected = F.when(F.col(platform) == name, moved).otherwise(corrected)
    return corrected


def clean_events(
    raw: DataFrame,
    shifts: Mapping[str, float] = defaults.CLOCK_SHIFT_HOURS,
    key: Sequence[str] = defaults.NATURAL_KEY,
    order: str = "event_id",
    clean: bool = True,
) -> DataFrame:
    """Events with a user, on corrected clocks, each natural key once.

    ``shifts`` maps a platform to the hours its timestamps are behind. Of the rows
    sharing ``key`` the one lowest in ``order`` survives. Filtering the row number to 1
    lets Spark keep one candidate per key in every map task, so a group of copies of
    any size reaches the shuffle already reduced. ``clean=False`` only adds the date.
    """
    # Spark sorts by the first column's prefix; the timestamp repeats least.
    key = sorted(key, key=lambda column: column != "event_ts")
    events = raw.select(*defaults.EVENT_COLUMNS)
    if clean:
        copies = Window.partitionBy(*key).orderBy(F.col(order).asc_nulls_last())
        events = (
            events.filter(F.col("user_id").isNotNull())
            .withColumn("event_ts", _corrected("event_ts", "platform", shifts))
            .withColumn("copy", F.row_number().over(copies))
            .filter(F.col("copy") == 1)
        )
    return events.select(
        "event_id",
        "user_id",
        "event_name",
        "event_ts",
        F.to_date("event_ts").alias("event_date"),
        "channel",
        "platform",
        "revenue",
    )


def first_touch_users(
    events: DataFrame, attrs: Sequence[str] = ("channel", "platform")
) -> DataFrame:
    """One row per user: first time seen, its date and week, and ``attrs`` at that moment.

    The earliest event decides, the lower event_id on a tie, and a NULL attribute stays
    NULL. The smallest struct is kept per map task first, so a very active user costs
    one row per task in the shuffle.
    """
    moment = F.struct(F.col("event_ts").isNull().alias("undated"), "event_ts", "event_id", *attrs)
    users = (
        events.groupBy("user_id")
        .agg(F.min(moment).alias("first"))
        .select("user_id", F.col("first.event_ts").alias("signup_ts"), *[f"first.{a}" for a in attrs])
    )
    return users.select(
        "user_id",
        "signup_ts",
        F.to_date("signup_ts").alias("signup_date"),
        monday_of(users, "signup_ts").alias("signup_week"),
        *attrs,
    )
