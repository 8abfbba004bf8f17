"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Queries that read the clean events more than once read them from tables that the call saves in
the shared folder; they go when the program ends.
Ratios that the operators leave unrounded are rounded here, because the last digits of
sine, square root and sums of doubles differ between engines.
"""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark as tm
from tidemark import defaults
from tidemark.plans.models import build_models
from tidemark.sources import layouts, tables
from workload.fixture import raw_events

# The events span 30 days, so day 20 is added to see a long horizon that is not zero.
PLUS_DAYS = (1, 7, 20, 30)
RATES = {"d1_exact": 1, "d7_exact": 7, "d7_plus": 7, "d20_plus": 20, "d30_plus": 30}
ELIGIBLE_DAYS = (1, 20, 30)
SLICE_DAY = date(2024, 1, 15)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _clean(spark: SparkSession, sf_dir: str, grain: str = "customer") -> DataFrame:
    return tm.clean_events(raw_events(spark, sf_dir, grain))


def _dirty(spark: SparkSession, sf_dir: str, grain: str = "customer") -> DataFrame:
    return tm.clean_events(raw_events(spark, sf_dir, grain), clean=False)


def _events_and_users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The device-grain staging tables, saved."""
    events = tables.materialise(_clean(spark, sf_dir, "device"))
    return events, tables.materialise(tm.first_touch_users(events))


# --- staging -----------------------------------------------------------------


def stg_events(spark, sf_dir):
    return _money(_clean(spark, sf_dir))


def stg_events_raw(spark, sf_dir):
    return _money(_dirty(spark, sf_dir))


def _money(events: DataFrame) -> DataFrame:
    return events.withColumn("revenue", F.col("revenue").cast("double"))


def stg_users(spark, sf_dir):
    return tm.first_touch_users(_clean(spark, sf_dir, "device"))


# --- sessions ----------------------------------------------------------------


def sessionise(spark, sf_dir):
    return tm.sessionise(tables.materialise(_money(_clean(spark, sf_dir))))


def session_summary(spark, sf_dir):
    return tm.session_summary(_clean(spark, sf_dir))


def session_count(spark, sf_dir):
    return tm.session_count(_clean(spark, sf_dir))


def session_totals(spark, sf_dir):
    return tm.session_totals(tm.session_summary(_clean(spark, sf_dir)))


def session_floor(spark, sf_dir):
    """First sessions with a purchase, one per user at most and not of every user, so there is a row."""
    events, users = _events_and_users(spark, sf_dir)
    bought = tm.session_summary(events).filter("session_index = 1 and converted = 1")
    return tm.session_floor(bought, users)


def session_gaps(spark, sf_dir):
    """Sessions of 30 minutes checked against a gap of 20: those that hold a longer one."""
    numbered = tm.sessionise(tables.materialise(_clean(spark, sf_dir)))
    return tm.session_gaps(numbered, gap_minutes=20)


# --- funnel ------------------------------------------------------------------


def funnel(spark, sf_dir):
    return tm.funnel(_clean(spark, sf_dir, "device"))


def funnel_by_channel(spark, sf_dir):
    events, users = _events_and_users(spark, sf_dir)
    return _rounded(tm.funnel_by(events, users), 9, "step_conversion")


def funnel_many_steps(spark, sf_dir):
    """A funnel of 100 steps: the values in the events' props, in order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "user_id",
        F.regexp_extract("props", "[0-9]+", 0).alias("event_name"),
        F.col("value").cast("decimal(18,2)").alias("revenue"),
    )
    steps = [str(i) for i in range(100)]
    return tm.funnel(events, steps=steps, goal="99").drop("max_recoverable_revenue")


def worst_step(spark, sf_dir):
    return tm.worst_step(funnel(spark, sf_dir))


def step_user_counts(spark, sf_dir):
    return tm.step_user_counts(_clean(spark, sf_dir, "device"))


def arpu(spark, sf_dir):
    return _rounded(tm.arpu(_clean(spark, sf_dir, "device")), 6, "arpu_per_purchaser")


def opportunity(spark, sf_dir):
    events, _ = _events_and_users(spark, sf_dir)
    sized = tm.opportunity(tm.funnel(events), events)
    return _rounded(sized, 6, "arpu_per_purchaser", "downstream_purchase_rate")


def detectable_effect(spark, sf_dir):
    effect = tm.detectable_effect(funnel(spark, sf_dir), per_arm=18_500)
    return _rounded(effect, 6, "detectable_absolute", "detectable_relative")


# --- retention ---------------------------------------------------------------


def _cohorts(events: DataFrame, users: DataFrame) -> DataFrame:
    return tm.retention(events, users, plus=PLUS_DAYS, rates=tuple(RATES))


def retention(spark, sf_dir):
    return _cohorts(*_events_and_users(spark, sf_dir))


def retention_extended(spark, sf_dir):
    """The same from an activity table: started with the first 20 days, extended by the other 10."""
    events, users = _events_and_users(spark, sf_dir)
    path, early = tables.shared_dir(spark), F.col("event_date") < date(2024, 1, 21)
    tm.extend_activity(spark, path, events.filter(early))
    activity = tm.extend_activity(spark, path, events.filter(~early))
    return tm.retention_of(activity, users, plus=PLUS_DAYS, rates=tuple(RATES))


def retention_by_channel(spark, sf_dir):
    events, users = _events_and_users(spark, sf_dir)
    cohorts = _cohorts(events, users)
    return tm.retention_by_segment(cohorts, events, rates=RATES, eligible=ELIGIBLE_DAYS)


def pooled_retention(spark, sf_dir):
    return _rounded(tm.pooled_retention(retention(spark, sf_dir)), 9, "d7_plus_rate")


def week_one(spark, sf_dir):
    return tm.week_one_dropoff(*_events_and_users(spark, sf_dir))


def week_one_by_channel(spark, sf_dir):
    return tm.week_one_dropoff(*_events_and_users(spark, sf_dir), by=["channel"])


def retention_curve(spark, sf_dir):
    return _rounded(tm.retention_curve(*_events_and_users(spark, sf_dir)), 9, "rate")


# --- comparison --------------------------------------------------------------


def two_proportion(spark, sf_dir):
    events, users = _events_and_users(spark, sf_dir)
    test = tm.two_proportion_test(users, events)
    return _rounded(test, 6, *[c for c, kind in test.dtypes if kind == "double"])


# --- quality -----------------------------------------------------------------


def audit(spark, sf_dir):
    raw = raw_events(spark, sf_dir)
    return tm.quality_audit(raw, tm.clean_events(raw))


def audit_by_event(spark, sf_dir):
    """An audit whose key has no user: one event of a name at a time, of whichever user."""
    raw, key = raw_events(spark, sf_dir), ("event_name", "event_ts")
    return tm.quality_audit(raw, tm.clean_events(raw, shifts={}, key=key), key)


def rate_in_band(spark, sf_dir):
    audited = tables.materialise(audit(spark, sf_dir))
    duplicates = tm.rate_in_band(audited, "duplicate_rate", *defaults.DUPLICATE_RATE_BAND)
    nulls = tm.rate_in_band(audited, "null_user_rate", *defaults.NULL_USER_RATE_BAND)
    tight = tm.rate_in_band(audited, "duplicate_rate", 0.0, 0.001)
    return duplicates.unionByName(nulls).unionByName(tight)


def circular_mean_hour(spark, sf_dir):
    return _rounded(tm.circular_mean_hour(_dirty(spark, sf_dir)), 6, "mean_hour")


def circular_mean_hour_clean(spark, sf_dir):
    return _rounded(tm.circular_mean_hour(_clean(spark, sf_dir)), 6, "mean_hour")


def hour_skew(spark, sf_dir):
    return tm.hour_skew(_dirty(spark, sf_dir))


def hour_spread(spark, sf_dir):
    return tm.hour_spread(_dirty(spark, sf_dir))


def hour_spread_half_day(spark, sf_dir):
    """Groups all around the clock, by the three hours that an event falls in: the farthest from each
    is about half a day away."""
    band = F.concat(F.lit("from "), F.expr("hour(event_ts) div 3 * 3").cast("string"))
    return tm.hour_spread(_dirty(spark, sf_dir).withColumn("band", band), "band", min_rows=0)


def hour_profile(spark, sf_dir):
    return tm.hour_profile(_dirty(spark, sf_dir))


def flat_hours(spark, sf_dir):
    """The events as given come at all hours alike, so there is a row."""
    return tm.flat_hours(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "event_ts"))


def dup_keys(spark, sf_dir):
    return tm.dup_keys(_dirty(spark, sf_dir))


def null_users(spark, sf_dir):
    return tm.null_rows(_dirty(spark, sf_dir), "user_id")


def before_signup(spark, sf_dir):
    return tm.events_before_signup(_dirty(spark, sf_dir, "device"))


def repeat_signups(spark, sf_dir):
    return tm.repeat_signups(_dirty(spark, sf_dir, "device"))


def funnel_monotonic(spark, sf_dir):
    return tm.funnel_not_monotonic(funnel(spark, sf_dir))


def _overcounted(spark, sf_dir):
    """Cohorts whose activity counts events where it should count users."""
    events, users = _events_and_users(spark, sf_dir)
    visits = events.select("user_id", "event_date").join(users.select("user_id", "signup_date", "channel"), "user_id")
    day = F.datediff("event_date", "signup_date")
    counts = visits.groupBy("signup_date", "channel").agg(
        *[F.count_if(day >= n).alias(f"d{n}_plus") for n in (1, 7, 30)]
    )
    cohorts = tm.retention(events, users).select("signup_date", "channel", "cohort_users")
    return cohorts.join(counts, ["signup_date", "channel"])


def retention_bound(spark, sf_dir):
    return tm.retention_over_cohort(_overcounted(spark, sf_dir))


def retention_over_count(spark, sf_dir):
    over = tm.retention_over_cohort(_overcounted(spark, sf_dir), ["d1_plus", "d30_plus"])
    return over.agg(F.count("*").alias("failed_rows"))


def segment_order(spark, sf_dir):
    """Channels in an expected order of their retention that the data does not bear out."""
    pooled = tm.pooled_retention(tm.retention(*_events_and_users(spark, sf_dir)))
    out = tm.segments_out_of_order(pooled, "d7_plus_rate", defaults.CHANNELS)
    return _rounded(out, 9, "better_rate", "worse_rate")


def rate_mismatch(spark, sf_dir):
    events, users = _events_and_users(spark, sf_dir)
    measured = tm.funnel_by(events, users)
    return _rounded(
        tm.rate_mismatch(measured, tm.expected_step_rates(spark)), 6, "step_conversion", "expected"
    )


def unique(spark, sf_dir):
    return tm.not_unique(_dirty(spark, sf_dir, "device"), "user_id")


def not_null(spark, sf_dir):
    return _money(tm.missing(_dirty(spark, sf_dir), "user_id"))


def accepted_values(spark, sf_dir):
    events = _dirty(spark, sf_dir)
    names = tm.bad_values(events, "event_name", defaults.STEPS)
    channels = tm.bad_values(events, "channel", defaults.CHANNELS[:3])
    return names.toDF("value", "n").unionByName(channels.toDF("value", "n"))


def orphans(spark, sf_dir):
    """Orders of customers who have no events."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return tm.orphans(orders, "o_custkey", tm.first_touch_users(_clean(spark, sf_dir)), "user_id")


def check_first_rows(spark, sf_dir):
    """The outcome of checks that fail, with their first rows."""
    events = _dirty(spark, sf_dir)
    return tm.run_checks(
        {
            "repeated": tm.dup_keys(events, ["user_id", "event_name"]),
            "no_user": tm.null_rows(events, "user_id"),
            "other_channel": tm.bad_values(events, "channel", defaults.CHANNELS[:3]),
            "many_events": tm.not_unique(events, "user_id"),
        }
    )


def _suite(spark, sf_dir, clean):
    suite = tm.run_suite(build_models(raw_events(spark, sf_dir), clean=clean))
    return suite.drop("first_row")


def check_suite_clean(spark, sf_dir):
    return _suite(spark, sf_dir, True)


def check_suite_dirty(spark, sf_dir):
    return _suite(spark, sf_dir, False)


def data_tests(spark, sf_dir):
    return tm.run_data_tests(build_models(raw_events(spark, sf_dir, "device"))).drop("first_row")


# --- layouts -----------------------------------------------------------------


def day_slice(spark, sf_dir):
    return tm.day_slice(_clean(spark, sf_dir), SLICE_DAY)


def _layouts(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    events = tables.materialise(_money(_clean(spark, sf_dir)))
    return tm.write_layouts(events, tables.shared_dir(spark))


def layout_sizes(spark, sf_dir):
    """What holds of the sizes in bytes at any scale."""
    sizes = tm.layout_sizes(spark, _layouts(spark, sf_dir))
    return sizes.select(
        "layout",
        (F.col("parquet_bytes") > 0).alias("has_bytes"),
        F.when(F.col("layout") == "narrow", F.col("bytes_vs_base") < 1).alias("below_base"),
    )


def layout_contents(spark, sf_dir):
    sizes = tm.layout_sizes(spark, _layouts(spark, sf_dir))
    return sizes.select("layout", "row_count", "column_count")


def layout_clustered(spark, sf_dir):
    path = tables.shared_dir(spark)
    layouts.write_clustered(_money(_clean(spark, sf_dir)), path)
    return spark.read.parquet(path)


def layout_narrow(spark, sf_dir):
    path = tables.shared_dir(spark)
    layouts.write_narrow(_clean(spark, sf_dir), path)
    return spark.read.parquet(path)


def layout_by_date(spark, sf_dir):
    """The one-day query on the by-date layout, which reads one folder."""
    path = tables.shared_dir(spark)
    layouts.write_by_date(_money(_clean(spark, sf_dir)), path)
    return tm.day_slice(spark.read.parquet(path), SLICE_DAY)


def layout_late_events(spark, sf_dir):
    """The by-date layout without its last day's purchases, which come late: rows of each date after
    they were added."""
    events, path = tables.materialise(_money(_clean(spark, sf_dir))), tables.shared_dir(spark)
    late = (F.col("event_date") == date(2024, 1, 30)) & (F.col("event_name") == "purchase")
    layouts.write_by_date(events.filter(~late), path)
    tm.add_to_dates(events.filter(late), path)
    return spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("events"), F.count_if(late).alias("late"))


def layout_bucketed(spark, sf_dir):
    """The funnel on the table bucketed by user, which takes no shuffle of events."""
    path = tables.shared_dir(spark)
    table = f"events_{path.rsplit('-', 1)[-1]}"
    return tm.funnel(tm.write_bucketed(_clean(spark, sf_dir, "device"), table, path, buckets=8))


def json_result(spark, sf_dir):
    """The funnel written as JSON lines and read back."""
    path = tables.shared_dir(spark)
    steps = funnel(spark, sf_dir)
    tables.write_json(steps, path)
    return spark.read.schema(steps.schema).json(path)


def mart_views(spark, sf_dir):
    """SQL over the registered views: sessions per first-touch channel."""
    tables.register_views(build_models(raw_events(spark, sf_dir)))
    return spark.sql(
        """
        SELECT channel, count(*) AS sessions, sum(event_count) AS events, sum(converted) AS converted
        FROM mart_sessions JOIN stg_users USING (user_id)
        GROUP BY channel
        """
    )


# --- the report --------------------------------------------------------------


def report(spark, sf_dir):
    """All answers of the report as (section, item, metric, value) rows."""
    # The answers' names, and the column that names their items.
    sections = {
        "funnel": "step",
        "retention_by_channel": "channel",
        "week_one": None,
        "channel_comparison": None,
        "opportunity": "scenario",
        "data_quality": None,
    }
    answers = tm.question_report(raw_events(spark, sf_dir, "device"))
    rows = None
    for section, item in sections.items():
        answer = answers[section]
        numbers = [c for c, kind in answer.dtypes if kind not in ("string", "date")]
        metrics = F.array(
            *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers]
        )
        part = answer.select(
            F.lit(section).alias("section"),
            (F.col(item) if item else F.lit(None).cast("string")).alias("item"),
            F.inline(metrics),
        )
        rows = part if rows is None else rows.unionByName(part)
    return _rounded(rows, 6, "value")


# The registered names.
QUERIES = {
    query.__name__: query
    for query in (
        stg_events,
        stg_events_raw,
        stg_users,
        sessionise,
        session_summary,
        session_count,
        session_totals,
        session_floor,
        session_gaps,
        funnel,
        funnel_many_steps,
        funnel_by_channel,
        worst_step,
        step_user_counts,
        arpu,
        opportunity,
        detectable_effect,
        retention,
        retention_extended,
        retention_by_channel,
        pooled_retention,
        week_one,
        week_one_by_channel,
        retention_curve,
        two_proportion,
        audit,
        audit_by_event,
        rate_in_band,
        circular_mean_hour,
        circular_mean_hour_clean,
        hour_skew,
        hour_spread,
        hour_spread_half_day,
        hour_profile,
        flat_hours,
        dup_keys,
        null_users,
        before_signup,
        repeat_signups,
        funnel_monotonic,
        retention_bound,
        retention_over_count,
        segment_order,
        rate_mismatch,
        unique,
        not_null,
        accepted_values,
        orphans,
        check_suite_clean,
        check_suite_dirty,
        check_first_rows,
        data_tests,
        day_slice,
        layout_sizes,
        layout_contents,
        layout_clustered,
        layout_narrow,
        layout_by_date,
        layout_late_events,
        layout_bucketed,
        json_result,
        mart_views,
        report,
    )
}
