"""Product analytics over event tables, on Spark DataFrames."""

from tidemark.operators.activity import active_days, extend_activity, merge_activity
from tidemark.operators.comparison import two_proportion_test
from tidemark.operators.funnel import (
    arpu,
    detectable_effect,
    funnel,
    funnel_by,
    opportunity,
    step_user_counts,
    worst_step,
)
from tidemark.operators.quality import (
    bad_values,
    circular_mean_hour,
    dup_keys,
    events_before_signup,
    expected_step_rates,
    flat_hours,
    funnel_not_monotonic,
    hour_profile,
    hour_skew,
    hour_spread,
    missing,
    not_unique,
    null_rows,
    orphan_rows,
    orphans,
    quality_audit,
    rate_in_band,
    rate_mismatch,
    repeat_signups,
    retention_over_cohort,
    run_checks,
    run_column_checks,
    segments_out_of_order,
    session_floor,
    session_gaps,
    session_totals,
)
from tidemark.operators.retention import (
    pooled_retention,
    retention,
    retention_by_segment,
    retention_curve,
    retention_curve_of,
    retention_of,
    week_one_dropoff,
)
from tidemark.operators.sessions import session_count, session_summary, sessionise
from tidemark.operators.staging import clean_events, first_touch_users
from tidemark.plans.checks import run_data_tests, run_suite
from tidemark.plans.models import build_models
from tidemark.plans.report import question_report, write_report
from tidemark.session import build_session
from tidemark.sources.layouts import add_to_dates, day_slice, layout_sizes, write_bucketed, write_layouts
from tidemark.sources.tables import (
    Workspace,
    as_events,
    materialise,
    read_events,
    register_views,
    write_json,
)
from tidemark.sources.versions import collect_garbage, open_table, save_table
