"""Data-quality audit and assertions. An assertion returns the offending rows, so it
passes when it is empty."""

from collections.abc import Mapping, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.functions.numbers import circular_hour, hours_apart, ratio
from tidemark.functions.times import epoch_minutes

# --- audit -------------------------------------------------------------------


def quality_audit(
    raw: DataFrame, clean: DataFrame, key: Sequence[str] = defaults.NATURAL_KEY
) -> DataFrame:
    """One row: what cleaning with the same ``key`` removed and why.

    ``raw`` is reduced once to its rows and rows without a user per key, which yields the rows,
    the repeats and the rows without a user together; ``clean`` to a count per user.
    """
    n, unknown = F.col("n"), F.col("unknown")
    nothing = F.lit(None).cast("bigint")
    keyed = raw.groupBy(*dict.fromkeys(key)).agg(
        F.count("*").alias("n"), F.count_if(F.col("user_id").isNull()).alias("unknown")
    )
    per_user = clean.groupBy("user_id").agg(F.count("*").alias("n"))
    from_raw = keyed.agg(
        F.sum("n").alias("raw_rows"),
        nothing.alias("clean_rows"),
        F.sum(F.greatest(n - unknown - 1, F.lit(0))).alias("duplicate_rows"),
        F.sum(unknown).alias("null_user_rows"),
        nothing.alias("clean_users"),
    )
    from_clean = per_user.agg(
        nothing.alias("raw_rows"),
        F.sum("n").alias("clean_rows"),
        nothing.alias("duplicate_rows"),
        nothing.alias("null_user_rows"),
        F.count("user_id").alias("clean_users"),
    )
    totals = from_raw.unionByName(from_clean).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in from_raw.columns]
    )
    return totals.select(
        "raw_rows",
        "clean_rows",
        (F.col("raw_rows") - F.col("clean_rows")).alias("rows_removed"),
        "duplicate_rows",
        ratio(F.col("duplicate_rows"), F.col("raw_rows"), 5).alias("duplicate_rate"),
        "null_user_rows",
        ratio(F.col("null_user_rows"), F.col("raw_rows"), 5).alias("null_user_rate"),
        "clean_users",
    )


# --- hour of day -------------------------------------------------------------


def circular_mean_hour(events: DataFrame, by: str = "platform") -> DataFrame:
    """Rows and circular mean hour per group.

    Events are counted per hour first: sine and cosine are then taken of at most 24
    rows per group, and the mean no longer depends on the order events arrive in.
    """
    angle = 2 * F.pi() * F.col("hour") / 24.0
    n = F.col("n")
    hourly = events.groupBy(by, F.hour("event_ts").alias("hour")).agg(F.count("*").alias("n"))
    dated = F.sum(F.when(F.col("hour").isNotNull(), n))
    return (
        hourly.groupBy(by)
        .agg(
            F.sum("n").alias("rows"),
            ratio(F.sum(n * F.sin(angle)), dated).alias("mean_sin"),
            ratio(F.sum(n * F.cos(angle)), dated).alias("mean_cos"),
        )
        .select(by, "rows", circular_hour(F.col("mean_sin"), F.col("mean_cos")).alias("mean_hour"))
    )


#: Each side of a bin is cut into so many cells: a row is written so many times, and a task
#: compares this many times this many fewer pairs.
CELLS = 8


def hour_skew(
    events: DataFrame,
    by: str = "platform",
    min_rows: int = defaults.SKEW_MIN_ROWS,
    max_hours: float = defaults.SKEW_MAX_HOURS,
) -> DataFrame:
    """Pairs of groups whose circular mean hours lie more than ``max_hours`` apart.

    Each group is matched only with whole-hour bins that can be far enough away, an
    equality join on the bin; the exact distance then decides. Both sides of a bin are cut into
    ``CELLS`` by a hash of the group, and each cell of one meets each cell of the other under a key
    of its own, so that groups which gather in few bins do not gather in few tasks. The result is as
    large as the number of such pairs, the square of the number of groups at worst; ``hour_spread``
    answers whether any group is off in one row per group.
    """
    means = (
        circular_mean_hour(events, by)
        .filter(F.col("rows") > min_rows)
        .select(by, "mean_hour", F.floor("mean_hour").cast("int").alias("bin"))
    )
    # Bins d apart hold hours less than d + 1 apart; 0.005 covers the rounding below.
    nearest = min(12, max(0, ceil(max_hours - 1.005)))
    far = F.explode(F.array(*[F.lit(d) for d in range(nearest, min(24, 25 - nearest))]))
    cell = F.pmod(F.xxhash64(by), F.lit(CELLS)).cast("int")
    cells = F.explode(F.array(*[F.lit(i) for i in range(CELLS)]))
    left = (
        means.select(F.col(by).alias(f"{by}_a"), F.col("mean_hour").alias("hour_a"), cell.alias("cell_a"), "bin", far.alias("away"))
        .withColumn("bin", (F.col("bin") + F.col("away")) % 24)
        .select(f"{by}_a", "hour_a", "bin", "cell_a", cells.alias("cell_b"))
    )
    right = means.select(F.col(by).alias(f"{by}_b"), F.col("mean_hour").alias("hour_b"), "bin", cells.alias("cell_a"), cell.alias("cell_b"))
    apart = F.round(hours_apart(F.col("hour_a"), F.col("hour_b")), 2)
    return (
        left.join(right, ["bin", "cell_a", "cell_b"])
        .filter(F.col(f"{by}_a") < F.col(f"{by}_b"))
        .select(
            f"{by}_a",
            f"{by}_b",
            F.round("hour_a", 2).alias("mean_hour_a"),
            F.round("hour_b", 2).alias("mean_hour_b"),
            apart.alias("hours_apart"),
        )
        .filter(F.col("hours_apart") > max_hours)
    )


#: Bins of the circle: one per minute of the day.
BINS = 1440


def _bin(hour: Column) -> Column:
    return F.floor(hour * (BINS // 24)).cast("int") % BINS


def _next_bins(means: DataFrame) -> Column:
    """Per bin the greatest mean of the bins before it and the least of those after it, around the
    circle, as an array of structs: of 1,440 rows, however many means there are."""
    bins = means.groupBy(_bin(F.col("mean_hour")).alias("bin")).agg(F.min("mean_hour").alias("least"), F.max("mean_hour").alias("most"))
    circle = means.sparkSession.range(BINS, numPartitions=1).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left")
    along = Window.orderBy("bin")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    most, least = F.last("most", ignorenulls=True), F.first("least", ignorenulls=True)
    before = F.coalesce(most.over(along.rowsBetween(first, -1)), most.over(along.rowsBetween(first, last)))
    after = F.coalesce(least.over(along.rowsBetween(1, last)), least.over(along.rowsBetween(first, last)))
    return circle.select(F.struct("bin", before.alias("before"), after.alias("after")).alias("ends")).agg(
        F.sort_array(F.collect_list("ends"))
    ).scalar()


def hour_spread(
    events: DataFrame, by: str = "platform", min_rows: int = defaults.SKEW_MIN_ROWS
) -> DataFrame:
    """Each group's circular mean hour and how far the farthest other group's lies from it.

    The farthest mean is the one nearest to the opposite hour, on either side of it: the means of
    the same minute as that hour are searched in their order, and beyond it the next minute that
    has any. That is exact, and linear in the number of groups but for the sort.
    """
    means = circular_mean_hour(events, by).filter(F.col("rows") > min_rows).select(by, "mean_hour")
    opposite = F.pmod(F.col("mean_hour") + 12.0, F.lit(24.0))
    asked = means.select(F.lit(True).alias("asked"), by, "mean_hour", opposite.alias("place"), F.lit(None).cast("double").alias("mean"))
    there = means.select("mean_hour").distinct().select(
        F.lit(False).alias("asked"),
        F.lit(None).cast(means.schema[by].dataType).alias(by),
        "mean_hour",
        F.col("mean_hour").alias("place"),
        F.col("mean_hour").alias("mean"),
    )
    in_bin = Window.partitionBy(_bin(F.col("place"))).orderBy("place")
    below = F.last("mean", ignorenulls=True).over(in_bin.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first("mean", ignorenulls=True).over(in_bin.rangeBetween(0, Window.unboundedFollowing))
    ends = F.get(_next_bins(means), _bin(F.col("place")))
    near = there.unionByName(asked).select(
        "asked", by, "mean_hour", below.alias("below"), above.alias("above"), ends["before"].alias("before"), ends["after"].alias("after")
    )
    farthest = F.greatest(*[hours_apart(F.col("mean_hour"), F.col(c)) for c in ("below", "above", "before", "after")])
    return near.filter("asked").select(by, F.round("mean_hour", 2).alias("mean_hour"), F.round(farthest, 2).alias("hours_apart"))


def hour_profile(events: DataFrame) -> DataFrame:
    """One row: how many events the least and the most frequent hour of the day have."""
    hourly = events.filter(F.col("event_ts").isNotNull()).groupBy(F.hour("event_ts").alias("hour")).agg(F.count("*").alias("n"))
    # Hours without an event count as zero; no event at all gives NULLs.
    least = F.when(F.count("*") == 24, F.min("n")).when(F.count("*") > 0, F.lit(0))
    return hourly.agg(least.alias("least"), F.max("n").alias("most"))


def flat_hours(events: DataFrame, times: float = defaults.PROFILE_TIMES) -> DataFrame:
    """The hour profile when its most frequent hour does not have more than ``times`` the events of
    the least: a clock shift would not show in such events, so that ``hour_spread`` proves nothing."""
    profile = hour_profile(events)
    return profile.filter(~F.coalesce(F.col("most") > F.col("least") * F.lit(times), F.lit(False)))


# --- assertions on events ----------------------------------------------------


def dup_keys(events: DataFrame, key: Sequence[str] = defaults.NATURAL_KEY) -> DataFrame:
    """Natural keys that occur more than once, with their count."""
    return events.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def null_rows(df: DataFrame, column: str) -> DataFrame:
    """One row with the number of NULLs in ``column``, no row when there are none."""
    nulls = df.agg(F.count_if(F.col(column).isNull()).alias("null_rows"))
    return nulls.filter(F.col("null_rows") > 0)


def events_before_signup(events: DataFrame, first: str = "signup") -> DataFrame:
    """Users with an event earlier than their first ``first`` event."""
    signup_ts = F.min(F.when(F.col("event_name") == first, F.col("event_ts")))
    return (
        events.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(signup_ts.alias("signup_ts"), F.min("event_ts").alias("first_ts"))
        .filter(F.col("first_ts") < F.col("signup_ts"))
    )


def repeat_signups(events: DataFrame, first: str = "signup") -> DataFrame:
    """Users with more than one ``first`` event."""
    return (
        events.filter(F.col("event_name") == first)
        .groupBy("user_id")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )


# --- assertions on columns ---------------------------------------------------


def not_unique(df: DataFrame, column: str) -> DataFrame:
    """Non-NULL values of ``column`` that occur more than once."""
    values = df.filter(F.col(column).isNotNull()).groupBy(column)
    return values.agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def missing(df: DataFrame, column: str) -> DataFrame:
    """The rows in which ``column`` is NULL."""
    return df.filter(F.col(column).isNull())


def bad_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values of ``column`` outside ``values``, with their count; NULL is not a value."""
    return df.filter(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-NULL values of ``child`` without a match in ``parent``, with their row count.

    Both sides are grouped before the join, so a value holding many rows is one row in
    the shuffle.
    """
    values = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return values.join(keys, column, "left_anti")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The rows of ``child`` with a non-NULL value that has no match in ``parent``."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


# --- assertions on the marts -------------------------------------------------


def funnel_not_monotonic(funnel: DataFrame) -> DataFrame:
    """Steps reached by more users than the step before."""
    return funnel.filter(F.col("users_reached") > F.col("users_previous_step")).select(
        "step_index", "step", "users_reached", "users_previous_step"
    )


def retention_over_cohort(
    retention: DataFrame,
    counts: Sequence[str] = ("d1_plus", "d7_plus", "d30_plus"),
    by: Sequence[str] = ("signup_date", "channel"),
) -> DataFrame:
    """Cohorts with a retention count above their size."""
    over: Column = F.lit(False)
    for count in counts:
        over = over | (F.col(count) > F.col("cohort_users"))
    return retention.filter(over).select(*by, "cohort_users", *counts)


def segments_out_of_order(
    segments: DataFrame, rate: str, order: Sequence[str], by: str = "channel"
) -> DataFrame:
    """Neighbours in ``order``, expected best first, of which the first does not have the higher
    ``rate``; a segment that is not there or has no rate is passed over."""
    place = F.array_position(F.array(*[F.lit(name) for name in order]), F.col(by))
    ranked = segments.withColumn("place", place).filter((F.col("place") > 0) & F.col(rate).isNotNull())
    # At most one row per name of ``order``.
    in_order = Window.orderBy("place")
    return (
        ranked.select(
            F.lag(by).over(in_order).alias("better"),
            F.col(by).alias("worse"),
            F.lag(rate).over(in_order).alias("better_rate"),
            F.col(rate).alias("worse_rate"),
        )
        .filter("better is not null and better_rate <= worse_rate")
    )


def session_totals(sessions: DataFrame) -> DataFrame:
    """Sessions and the users they belong to, as one row."""
    per_user = sessions.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("sessions"), F.count("user_id").alias("users")
    )


def session_floor(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions and ``users`` when there are fewer sessions than users, else no row."""
    counted = sessions.agg(F.count("*").alias("sessions"), F.lit(0).alias("users")).unionByName(
        users.agg(F.lit(0).alias("sessions"), F.count("user_id").alias("users"))
    )
    totals = counted.agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"))
    return totals.filter(F.col("sessions") < F.col("users"))


def session_gaps(numbered: DataFrame, gap_minutes: int = defaults.GAP_MINUTES) -> DataFrame:
    """Where a session holds a gap above ``gap_minutes``, or starts after none.

    ``numbered`` has ``session_index``, as ``sessionise`` adds it. Sessions depend on the minutes
    a user was active in only, so those are what the window sees.
    """
    minutes = numbered.select("user_id", "session_index", epoch_minutes(numbered, "event_ts").alias("minute")).distinct()
    timeline = Window.partitionBy("user_id").orderBy("minute", "session_index")
    since = F.col("minute") - F.lag("minute").over(timeline)
    starts = F.col("session_index") != F.lag("session_index").over(timeline)
    return (
        minutes.select("user_id", "session_index", since.alias("minutes_since"), starts.alias("starts"))
        .filter(F.col("starts") != (F.col("minutes_since") > gap_minutes))
    )


def rate_in_band(audit: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The audit rate when it is not strictly between ``low`` and ``high``."""
    inside = (F.col(column) > low) & (F.col(column) < high)
    return audit.filter(~F.coalesce(inside, F.lit(False))).select(
        F.lit(column).alias("rate_name"), F.col(column).alias("rate")
    )


def expected_step_rates(
    spark: SparkSession,
    rates: Mapping[str, float] = defaults.STEP_RATES,
    multipliers: Mapping[str, float] = defaults.CHANNEL_MULTIPLIERS,
    cap: float = defaults.RATE_CAP,
    by: str = "channel",
) -> DataFrame:
    """The step conversion each segment should show: step rate times multiplier, capped."""
    rows = [
        F.struct(F.lit(c).alias(by), F.lit(s).alias("step"), F.lit(min(r * m, cap)).alias("expected"))
        for c, m in multipliers.items()
        for s, r in rates.items()
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rate_mismatch(
    measured: DataFrame,
    expected: DataFrame,
    tolerance: float = defaults.RATE_TOLERANCE,
    by: str = "channel",
) -> DataFrame:
    """Segment steps whose conversion is ``tolerance`` or more away from ``expected``."""
    return (
        measured.join(expected, [by, "step"])
        .filter(F.abs(F.col("step_conversion") - F.col("expected")) >= tolerance)
        .select(by, "step", "step_conversion", "expected")
    )


# --- suites ------------------------------------------------------------------


def run_checks(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check: its name, its offending rows and the first of them as JSON.

    All checks run as one job. "First" is the smallest JSON text, so reruns agree.
    """
    counted = [
        offending.agg(
            F.count("*").alias("failed_rows"), F.min(F.to_json(F.struct("*"))).alias("first_row")
        ).select(F.lit(name).alias("name"), "failed_rows", "first_row")
        for name, offending in checks.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def run_column_checks(
    df: DataFrame,
    present: Mapping[str, str] = {},
    accepted: Mapping[str, tuple[str, Sequence]] = {},
    null_rows: Mapping[str, str] = {},
) -> DataFrame:
    """The same columns as ``run_checks`` for assertions on single columns, in one pass over ``df``.

    ``present`` and ``null_rows`` map a check's name to a column, ``accepted`` to a column and
    its values. Each fails as ``missing``, ``null_rows`` and ``bad_values`` do. A row lists the
    checks it fails, if any, and what is listed is counted per check and value.
    """
    fails = [
        F.when(F.col(c).isNull(), _failure(name, None, F.to_json(F.struct("*")))) for name, c in present.items()
    ]
    fails += [F.when(F.col(c).isNull(), _failure(name, None, None)) for name, c in null_rows.items()]
    fails += [
        F.when(~F.col(c).isin(*values), _failure(name, F.col(c).cast("string"), None))
        for name, (c, values) in accepted.items()
    ]
    listed = df.select(F.inline(F.filter(F.array(*fails), lambda f: f.isNotNull())))
    per_value = listed.groupBy("name", "value").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    row, failed = F.col("row"), F.col("n")
    for name in null_rows:
        here = F.col("name") == name
        row = F.when(here, F.to_json(F.struct(F.col("n").alias("null_rows")))).otherwise(row)
        failed = F.when(here, F.lit(1)).otherwise(failed)
    for name, (column, _) in accepted.items():
        here = F.col("name") == name
        row = F.when(here, F.to_json(F.struct(F.col("value").alias(column), "n"))).otherwise(row)
        failed = F.when(here, F.lit(1)).otherwise(failed)
    found = per_value.select("name", failed.alias("failed_rows"), row.alias("first_row"))
    names = [*present, *null_rows, *accepted]
    none = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(0).cast("bigint").alias("failed_rows"), F.lit(None).cast("string").alias("first_row"))
            for n in names
        ]
    )
    every = df.sparkSession.range(1).select(F.inline(none)).unionByName(found)
    return every.groupBy("name").agg(F.sum("failed_rows").alias("failed_rows"), F.min("first_row").alias("first_row"))


def _failure(name: str, value: Column | None, row: Column | None) -> Column:
    text = F.lit(None).cast("string")
    return F.struct(
        F.lit(name).alias("name"),
        (text if value is None else value).alias("value"),
        (text if row is None else row).alias("row"),
    )
