"""All models of the warehouse from one raw event table."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from tidemark.operators.funnel import funnel
from tidemark.operators.quality import quality_audit
from tidemark.operators.retention import retention
from tidemark.operators.sessions import session_summary
from tidemark.operators.staging import clean_events, first_touch_users
from tidemark.sources.tables import shared_dir
from tidemark.sources.versions import save_table


def build_models(raw: DataFrame, root: str | None = None, clean: bool = True) -> dict[str, DataFrame]:
    """Raw, staging and mart tables by name.

    Every model but the raw table is saved under ``root`` (a new shared folder if not
    given): five of them read the clean events, and reports read the marts repeatedly.
    The marts do not depend on each other, so their jobs are submitted together and the
    last tasks of one do not leave executors idle.
    """
    root = (root or shared_dir(raw.sparkSession)).rstrip("/")

    def saved(name: str, df: DataFrame) -> DataFrame:
        return save_table(df, f"{root}/{name}")

    events = saved("stg_events", clean_events(raw, clean=clean))
    users = saved("stg_users", first_touch_users(events))
    marts = {
        "mart_sessions": session_summary(events),
        "mart_funnel": funnel(events),
        "mart_retention": retention(events, users),
        "audit_data_quality": quality_audit(raw, events),
    }
    with ThreadPoolExecutor(len(marts)) as pool:
        tables = dict(zip(marts, pool.map(saved, marts, marts.values())))
    return {"raw_events": raw, "stg_events": events, "stg_users": users, **tables}
