"""Where new users are lost in week one, and what fixing it is worth."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import defaults
from tidemark.operators.comparison import two_proportion_test
from tidemark.operators.funnel import opportunity
from tidemark.operators.retention import retention_by_segment, week_one_dropoff
from tidemark.plans.models import build_models
from tidemark.sources.tables import write_json


#: How the numbers come about: answer, item, value.
METHOD = (
    ("channel_comparison", "test", "z test of two proportions, two-sided"),
    ("channel_comparison", "alpha", str(defaults.ALPHA)),
    ("channel_comparison", "p_value", "standard error of both segments pooled"),
    ("channel_comparison", "interval", "standard errors of the segments taken apart"),
    ("opportunity", "scenarios", ", ".join(f"{n} {r:.0%}" for n, r in defaults.SCENARIOS.items())),
    ("opportunity", "later steps", "users won back are taken to go on like those who passed the step: an upper bound"),
    ("opportunity", "revenue", "per purchaser over all events, so that recent users count for less"),
    ("opportunity", "cost", "none taken off"),
)


def question_report(raw: DataFrame, root: str | None = None) -> dict[str, DataFrame]:
    """The six answers by name, over models saved under ``root``, and how they were reached."""
    models = build_models(raw, root)
    events, users = models["stg_events"], models["stg_users"]
    # The answers' names.
    return {
        "funnel": models["mart_funnel"],
        "retention_by_channel": retention_by_segment(models["mart_retention"], events),
        "week_one": week_one_dropoff(events, users),
        "channel_comparison": two_proportion_test(users, events),
        "opportunity": opportunity(models["mart_funnel"], events),
        "data_quality": models["audit_data_quality"],
        "method": raw.sparkSession.range(1).select(
            F.inline(F.array(*[F.struct(*map(F.lit, row)) for row in METHOD])).alias("answer", "item", "value")
        ),
    }


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per answer."""
    for name, answer in report.items():
        write_json(answer, f"{path.rstrip('/')}/{name}")
