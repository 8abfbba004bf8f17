"""The days each user was active on, as a table that grows by a day's events at a time.

A row is a user and a word of 64 days (``word`` is the day since 1970 divided by 64), with a bit per
day and the last active day. Bits add up by a bitwise or, so the activity of two sets of events,
overlapping or not, merges into that of both: a retention report needs the activity and the new
events, not all events again. A user with any number of events is one row per map task and word, and a
calendar of years is a few words.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.versions import open_table, save_table

WORD_BITS = 6


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "word").agg(F.bit_or("bits").alias("bits"), F.max("last_day").alias("last_day"))


def word_of(day: Column) -> Column:
    """The word of a day number; negative ones, before 1970, included."""
    return F.shiftright(day, WORD_BITS)


def bit_of(day: Column) -> Column:
    return day.bitwiseAND(F.lit((1 << WORD_BITS) - 1))


def active_days(events: DataFrame) -> DataFrame:
    """``user_id``, ``word``, ``bits`` and ``last_day`` of the users of ``events``; events without a
    time leave no trace, those without a user are a NULL user's."""
    day = F.unix_date(F.to_date("event_ts"))
    dated = events.filter(F.col("event_ts").isNotNull()).select("user_id", day.alias("day"))
    shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit_of(F.col("day")))
    return _merged(
        dated.select("user_id", word_of(F.col("day")).alias("word"), shifted.alias("bits"), F.date_from_unix_date("day").alias("last_day"))
    )


def merge_activity(*parts: DataFrame) -> DataFrame:
    """The activity of several sets of events together; days that they share count once."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return _merged(rows)


def extend_activity(spark: SparkSession, path: str, events: DataFrame) -> DataFrame:
    """Adds ``events`` to the activity table at ``path``, which they start if there is none, and
    returns it. Adding the same events again changes nothing; a run that fails neither."""
    try:
        known = open_table(spark, path)
    except ValueError:
        return save_table(active_days(events), path)
    return save_table(merge_activity(known, active_days(events)), path)


def active_on(signup: Column, day: int) -> Column:
    """Whether a row of the activity says that its user was active ``day`` days after ``signup``."""
    target = F.unix_date(signup) + day
    bit = F.call_function("getbit", F.col("bits"), bit_of(target))
    return (F.col("word") == word_of(target)) & (bit == 1)
