"""Sessions split at inactivity gaps.

A gap is measured in minute boundaries, so events of one user in one minute always
share a session and the split depends only on which minutes a user was active in.

``sessionise`` numbers every event in one pass over rows dealt out by ranges of (user, time), so
a busy user's events spread over many tasks. Each task numbers its rows as they come; how many
sessions a range's first user has had before it follows from one boundary record per range, added up
along the ranges. ``session_summary`` and ``session_count`` need no row per event and run their window
over distinct (user, minute) pairs: map tasks collapse the events first, and the window
partition of even the busiest user holds at most one row per minute of the calendar.

An event without a time has no place in a user's order: the operators stop with an error when
they meet one (``missing(events, "event_ts")`` finds them before).
"""

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, LongType, StructField, StructType

from tidemark import defaults
from tidemark.functions.times import epoch_minutes, seconds_between
from tidemark.sources.tables import materialise


UNDATED = "an event has no event_ts"


def _minutes(events: DataFrame) -> DataFrame:
    undated = F.raise_error(F.lit(UNDATED))
    minute = F.when(F.col("event_ts").isNull(), undated.cast("bigint")).otherwise(epoch_minutes(events, "event_ts"))
    return events.withColumn("_minute", minute)


def _numbered(minutes: DataFrame, gap_minutes: int) -> DataFrame:
    """Adds session_index to one row per (user_id, minute)."""
    timeline = Window.partitionBy("user_id").orderBy(F.col("_minute").asc_nulls_last())
    previous = F.lag("_minute").over(timeline)
    starts = previous.isNull() | (F.col("_minute") - previous > gap_minutes)
    return minutes.withColumn("starts", F.when(starts, 1).otherwise(0)).withColumn(
        "session_index",
        F.sum("starts").over(timeline.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )


def _number_ranges(ranged: DataFrame, gap_minutes: int) -> DataFrame:
    """Adds ``_local``, the session's index counted from 1 for each user within a partition whose
    rows are sorted by user and time, and ``_first``, whether the user is the partition's first one.
    Columns pass through as Arrow buffers; only user and minute are looked at, a batch at a time."""

    def same(users: pa.Array, before: pa.Array) -> np.ndarray:
        both_null = pc.and_(pc.is_null(users), pc.is_null(before))
        return pc.or_(pc.fill_null(pc.equal(users, before), False), both_null).to_numpy(zero_copy_only=False)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_user, last_minute, index, first = None, 0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            users, minutes = batch.column("user_id"), pc.fill_null(batch.column("_minute"), 0).to_numpy()
            known = np.zeros(n, bool)
            known[1:] = same(users.slice(1), users.slice(0, n - 1))
            known[0] = last_user is not None and same(users.slice(0, 1), last_user)[0]
            starts = ~known | (np.diff(minutes, prepend=last_minute) > gap_minutes)
            so_far = starts.cumsum()
            # What was counted before each row's user began; the first user may go on from before.
            before = np.maximum.accumulate(np.where(known, -index, so_far - 1))
            local = so_far - before
            changes = (~known).cumsum() - (last_user is None)
            firsts = first & (changes == 0)
            last_user, last_minute, index, first = users.slice(n - 1), minutes[-1], int(local[-1]), bool(firsts[-1])
            names = [*batch.schema.names, "_local", "_first"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64()), pa.array(firsts)], names)

    added = [StructField("_local", LongType()), StructField("_first", BooleanType())]
    return ranged.mapInArrow(number, StructType([*ranged.schema.fields, *added]))


def _carried(numbered: DataFrame, gap_minutes: int) -> Column:
    """Per range, as an array: how many sessions its first user has had before it.

    A range that goes on with the user the one before ended with adds that one's last number, less
    one if the gap between them is short, and what that one itself had to add if it holds no
    other user. The driver sees one row per range, a few thousand at most."""
    place = F.struct("user_id", "_minute", "_local")
    ends = numbered.groupBy("_range").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    carried, before = {}, None
    for r in sorted(ends.collect(), key=lambda r: r._range):
        carried[r._range] = 0
        if before is not None and before.last.user_id == r.first.user_id:
            whole = before.first.user_id == before.last.user_id
            short = (r.first._minute or 0) - (before.last._minute or 0) <= gap_minutes
            carried[r._range] = before.last._local - short + (carried[before._range] if whole else 0)
        before = r
    listed = [carried.get(i, 0) for i in range(max(carried, default=-1) + 1)]
    return F.from_json(F.lit(json.dumps(listed)), "array<bigint>")


def sessionise(events: DataFrame, gap_minutes: int = defaults.GAP_MINUTES) -> DataFrame:
    """Every event with the index of its session, counted from 1 within the user.

    Rows shuffle once, to ranges of (user, time), and are saved there with their numbers; the result
    reads that copy, without a join, and adds what is carried over from earlier ranges, which is
    found from one row per range. The bounds of the ranges come from a sample that Spark takes of
    ``events`` first, so anything costly above it should be saved before.
    """
    order = ["user_id", "event_ts"]
    # Retries and beacons may give many events one user and time; ids tell them apart.
    ties = [c for c in ("event_id",) if c in events.columns]
    timed = events.withColumn("_minute", epoch_minutes(events, "event_ts"))
    ranged = timed.repartitionByRange(*order, *ties).sortWithinPartitions(*order)
    numbered = materialise(_number_ranges(ranged.withColumn("_range", F.spark_partition_id()), gap_minutes))
    carried = F.get(_carried(numbered, gap_minutes), F.col("_range"))
    dated = F.when(F.col("_minute").isNull(), F.raise_error(F.lit(UNDATED)).cast("boolean")).otherwise(F.lit(True))
    index = F.col("_local") + F.when(F.col("_first"), carried).otherwise(F.lit(0))
    return numbered.filter(dated).select(*events.columns, index.alias("session_index"))


def session_summary(
    events: DataFrame,
    gap_minutes: int = defaults.GAP_MINUTES,
    goal: str = defaults.GOAL,
) -> DataFrame:
    """One row per session: id, span, events, revenue and whether it reached ``goal``.

    Built from per-minute totals instead of numbered events, which avoids joining the
    index back; the last grouping reuses the window's partitioning.
    """
    minutes = (
        _minutes(events)
        .groupBy("user_id", "_minute")
        .agg(
            F.min("event_ts").alias("first_ts"),
            F.max("event_ts").alias("last_ts"),
            F.count("*").alias("events"),
            F.sum("revenue").alias("revenue"),
            F.max(F.when(F.col("event_name") == goal, 1).otherwise(0)).alias("reached"),
        )
    )
    sessions = (
        _numbered(minutes, gap_minutes)
        .groupBy("user_id", "session_index")
        .agg(
            F.min("first_ts").alias("session_start"),
            F.max("last_ts").alias("session_end"),
            F.sum("events").alias("event_count"),
            F.sum("revenue").alias("session_revenue"),
            F.max("reached").alias("converted"),
        )
    )
    revenue = F.col("session_revenue")
    if isinstance(sessions.schema["session_revenue"].dataType, DecimalType):
        revenue = revenue.cast("double")
    return sessions.select(
        "user_id",
        F.concat(
            F.col("user_id").cast("string"), F.lit("_s"), F.col("session_index").cast("string")
        ).alias("session_id"),
        "session_index",
        "session_start",
        "session_end",
        seconds_between(sessions, "session_start", "session_end").alias("session_seconds"),
        "event_count",
        revenue.alias("session_revenue"),
        "converted",
    )


def session_count(events: DataFrame, gap_minutes: int = defaults.GAP_MINUTES) -> DataFrame:
    """How many events were given a session, as one row, without numbering them singly."""
    minutes = (
        _minutes(events)
        .groupBy("user_id", "_minute")
        .agg(F.count("*").alias("n"))
    )
    numbered = F.when(F.col("session_index").isNotNull(), F.col("n")).otherwise(0)
    return _numbered(minutes, gap_minutes).agg(
        F.coalesce(F.sum(numbered), F.lit(0)).alias("events")
    )
