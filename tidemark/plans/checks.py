"""The standard check suite over a built set of models."""

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.operators import quality
from tidemark.operators.funnel import funnel_by
from tidemark.operators.retention import pooled_retention
from tidemark.operators.sessions import sessionise


def model_checks(models: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Assertions across rows and tables."""
    events = models["stg_events"]
    far = quality.hour_spread(events).filter(F.col("hours_apart") > defaults.SKEW_MAX_HOURS)
    checks = {
        "no_duplicate_events": quality.dup_keys(events),
        "no_platform_hour_skew": far,
        "funnel_is_monotonic": quality.funnel_not_monotonic(models["mart_funnel"]),
        "retention_within_cohort": quality.retention_over_cohort(models["mart_retention"]),
        "signup_is_first_event": quality.events_before_signup(events),
        "session_users_exist": quality.orphan_rows(
            models["mart_sessions"], "user_id", models["stg_users"], "user_id"
        ),
    }
    return checks | {f"unique_{t}_{c}": quality.not_unique(models[t], c) for t, c in UNIQUE}


def data_tests(models: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Assertions on what the numbers should come out as, beyond the form of the tables: they hold
    for the product they were set for, while ``model_checks`` hold for any."""
    events, users, audit = (models[t] for t in ("stg_events", "stg_users", "audit_data_quality"))
    pooled = pooled_retention(models["mart_retention"])
    return {
        "one_signup_per_user": quality.repeat_signups(events),
        "session_gaps": quality.session_gaps(sessionise(events)),
        "sessions_cover_users": quality.session_floor(models["mart_sessions"], users),
        "duplicate_rate_in_band": quality.rate_in_band(audit, "duplicate_rate", *defaults.DUPLICATE_RATE_BAND),
        "null_user_rate_in_band": quality.rate_in_band(audit, "null_user_rate", *defaults.NULL_USER_RATE_BAND),
        "channels_in_order": quality.segments_out_of_order(pooled, "d7_plus_rate", defaults.CHANNELS),
        "step_rates_recovered": quality.rate_mismatch(funnel_by(events, users), quality.expected_step_rates(events.sparkSession)),
        "hours_not_flat": quality.flat_hours(events),
    }


# The columns declared unique, present, or limited to a list.
UNIQUE = (
    ("raw_events", "event_id"),
    ("stg_events", "event_id"),
    ("stg_users", "user_id"),
    ("mart_sessions", "session_id"),
    ("mart_funnel", "step"),
)
PRESENT = (
    ("raw_events", "event_id"),
    ("raw_events", "event_ts"),
    ("stg_events", "event_id"),
    ("stg_events", "user_id"),
    ("stg_events", "event_name"),
    ("stg_events", "event_ts"),
    ("stg_users", "user_id"),
    ("stg_users", "signup_ts"),
    ("stg_users", "channel"),
    ("mart_sessions", "session_id"),
    ("mart_sessions", "user_id"),
    ("mart_funnel", "step"),
    ("mart_retention", "cohort_users"),
)
ACCEPTED = (
    ("stg_events", "event_name", defaults.EVENT_NAMES),
    ("stg_events", "platform", defaults.PLATFORMS),
    ("stg_users", "channel", defaults.CHANNELS),
)


def column_checks(models: Mapping[str, DataFrame]) -> list[DataFrame]:
    """The outcome of the assertions declared on single columns, one pass per table."""
    outcomes = []
    for table in dict.fromkeys(t for t, *_ in (*PRESENT, *ACCEPTED)):
        outcomes.append(
            quality.run_column_checks(
                models[table],
                present={f"not_null_{t}_{c}": c for t, c in PRESENT if t == table},
                accepted={f"accepted_{t}_{c}": (c, v) for t, c, v in ACCEPTED if t == table},
                null_rows={"no_null_user_ids": "user_id"} if table == "stg_events" else {},
            )
        )
    return outcomes


def run_data_tests(models: Mapping[str, DataFrame]) -> DataFrame:
    """Name, offending rows and first offending row of every data test."""
    return quality.run_checks(data_tests(models))


def run_suite(models: Mapping[str, DataFrame]) -> DataFrame:
    """Name, offending rows and first offending row of every check."""
    return reduce(DataFrame.unionByName, column_checks(models), quality.run_checks(model_checks(models)))
