"""Timestamp arithmetic that counts calendar boundaries, not elapsed time.

The helpers look at the column's type: zoned timestamps are read as epoch time,
naive ones field by field, so neither depends on daylight saving in the session zone.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType


def _zoned(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, TimestampType)


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970, rounded down."""
    if _zoned(df, name):
        return F.unix_seconds(name)
    return F.expr(
        f"unix_date(to_date({name})) * 86400L + hour({name}) * 3600 + minute({name}) * 60 + second({name})"
    )


def epoch_minutes(df: DataFrame, name: str) -> Column:
    """Whole minutes since 1970, rounded down."""
    if _zoned(df, name):
        return F.floor(F.unix_seconds(name) / 60)
    return F.expr(f"unix_date(to_date({name})) * 1440L + hour({name}) * 60 + minute({name})")


def seconds_between(df: DataFrame, start: str, end: str) -> Column:
    """Second boundaries crossed from ``start`` to ``end``."""
    return epoch_seconds(df, end) - epoch_seconds(df, start)


def monday_of(df: DataFrame, name: str) -> Column:
    """Midnight of the Monday on or before ``name``, in the type of ``name``."""
    day = F.to_date(name)
    return F.date_sub(day, F.weekday(day)).cast(df.schema[name].dataType)
