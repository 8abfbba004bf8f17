import sys
from datetime import datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SCHEMA = (
    "event_id string, user_id string, event_name string, event_ts {ts}, "
    "channel string, platform string, revenue double"
)


@pytest.fixture(scope="session")
def spark():
    from tidemark import build_session

    session = build_session(
        "tests",
        master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """A time of day on 2026-03-02, a Monday, or a full timestamp."""
    return datetime.fromisoformat(text if "-" in text else f"2026-03-02 {text}")


@pytest.fixture(scope="session")
def make_events(spark):
    """Builds an event table from dicts; what a row leaves out gets a default."""

    def make(rows, ts="timestamp_ntz"):
        defaults = {
            "user_id": "u1",
            "event_name": "session_start",
            "event_ts": "10:00:00",
            "channel": "organic",
            "platform": "web",
            "revenue": 0.0,
        }
        tuples = []
        for i, row in enumerate(rows):
            full = {"event_id": f"e{i:04d}", **defaults, **row}
            stamp = full["event_ts"]
            full["event_ts"] = at(stamp) if isinstance(stamp, str) else stamp
            tuples.append(tuple(full[c] for c in ("event_id", *defaults)))
        return spark.createDataFrame(tuples, SCHEMA.format(ts=ts))

    return make


def rows(df, *columns):
    """Rows as tuples, ordered."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is None, str(v)) for v in t])
