"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Clean events are saved once in every layout, as the reference numbers were taken on saved
tables. Each query then runs once unmeasured and $BENCH_REPEATS times measured; the median
counts. The result of every run is collected in full, or written to a no-op sink where it
has as many rows as the events.

$BENCH_SCALE repeats every event so many times, each copy under ids and users of its own;
$BENCH_SKEW moves that share of all rows to one user. With either, only the operators that
meet events user by user are timed, and on standard error each also shows the longest and the
median task of its longest stage, read from Spark's event log.
"""

import json
import os
import statistics
import sys
import tempfile
import time
from collections import defaultdict
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

import tidemark as tm
from tidemark.operators import quality
from tidemark.plans.models import build_models
from tidemark.sources.tables import shared_dir
from workload.fixture import raw_events

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))
SCALE = int(os.environ.get("BENCH_SCALE", "1"))
SKEW = float(os.environ.get("BENCH_SKEW", "0"))
SLICE_DAY = date(2024, 1, 15)


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def timed(action):
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def enlarged(raw):
    """The raw events $BENCH_SCALE times over, a share of $BENCH_SKEW with one user."""
    copies = raw.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(SCALE - 1))))
    one = F.pmod(F.xxhash64("event_id", "copy"), F.lit(1000)) < round(1000 * SKEW)
    user = F.when(F.col("user_id").isNull(), None).when(one, F.lit(0)).otherwise(F.col("user_id") * SCALE + F.col("copy"))
    return copies.select(
        (F.col("event_id") * SCALE + F.col("copy")).alias("event_id"), user.cast("bigint").alias("user_id"), *raw.columns[2:]
    )


def slowest_stage(log, since):
    """Longest and median task, in seconds, of the stage that took longest since a time."""
    tasks = defaultdict(list)
    for line in log.open():
        event = json.loads(line)
        if event["Event"] == "SparkListenerTaskEnd" and event["Task Info"]["Launch Time"] >= since * 1000:
            tasks[event["Stage ID"]].append(event["Task Metrics"]["Executor Run Time"] / 1000)
    longest = max(tasks.values(), key=sum, default=[0.0])
    return max(longest), statistics.median(longest)


def skewed(spark, log, root) -> tuple[dict, dict]:
    raw = tm.save_table(enlarged(raw_events(spark, SF_DIR)), f"{root}/raw")
    events = tm.save_table(tm.clean_events(raw), f"{root}/events")
    runs = {
        "clean_events": lambda: noop(tm.clean_events(raw)),
        "first_touch_users": lambda: noop(tm.first_touch_users(events)),
        "sessionise_rows": lambda: noop(tm.sessionise(events)),
        "session_summary": lambda: noop(tm.session_summary(events)),
        "funnel": lambda: tm.funnel(events).collect(),
        "retention": lambda: tm.retention(events, tm.first_touch_users(events)).collect(),
        "quality_audit": lambda: tm.quality_audit(raw, events).collect(),
    }
    queries = {}
    for name, run in runs.items():
        run()
        began = time.time()
        queries[name] = round(statistics.median(timed(run) for _ in range(REPEATS)), 4)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        most, middle = slowest_stage(next(Path(log).iterdir()), began)
        print(f"{name:24} {queries[name]:8.3f} s, longest task {most:.3f} s, median {middle:.3f} s", file=sys.stderr)
    return queries, {"raw_events": raw.count(), "stg_events": events.count()}


def main() -> None:
    log = tempfile.mkdtemp(prefix="bench-log-")
    logged = {
        "spark__eventLog__enabled": "true",
        "spark__eventLog__dir": f"file://{log}",
        "spark__eventLog__compress": "false",
        "spark__eventLog__rolling__enabled": "false",
        "spark__eventLog__buffer__kb": "1k",
    }
    spark = tm.build_session(
        "bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        # The tables are small: keep one file and one task per core instead of one per MB.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64KB",
        **(logged if SCALE > 1 or SKEW else {}),
    )
    spark.sparkContext.setLogLevel("ERROR")
    root = shared_dir(spark)
    if SCALE > 1 or SKEW:
        return report(*skewed(spark, log, root))

    raw = tm.save_table(raw_events(spark, SF_DIR), f"{root}/raw")
    device_raw = tm.save_table(raw_events(spark, SF_DIR, "device"), f"{root}/device_raw")
    paths = tm.write_layouts(tm.clean_events(raw), f"{root}/layouts")
    layouts = {name: spark.read.parquet(path) for name, path in paths.items()}
    base = layouts["base"]
    events = tm.save_table(tm.clean_events(device_raw), f"{root}/events")
    users = tm.save_table(tm.first_touch_users(events), f"{root}/users")
    cohorts = tm.save_table(tm.retention(events, users), f"{root}/retention")
    steps = tm.save_table(tm.funnel(events), f"{root}/funnel")

    runs = {}
    for name in ("base", "clustered"):
        runs[f"sessionise_{name}"] = lambda t=layouts[name]: tm.session_count(t).collect()
        runs[f"one_day_slice_{name}"] = lambda t=layouts[name]: tm.day_slice(t, SLICE_DAY).collect()
    for name in ("base", "clustered", "narrow"):
        runs[f"funnel_counts_{name}"] = lambda t=layouts[name]: tm.step_user_counts(t).collect()
    runs |= {
        "one_day_slice_by_date": lambda: tm.day_slice(layouts["by_date"], SLICE_DAY).collect(),
        "clean_events": lambda: noop(tm.clean_events(raw)),
        "first_touch_users": lambda: noop(tm.first_touch_users(events)),
        "sessionise_rows": lambda: noop(tm.sessionise(base)),
        "session_summary": lambda: noop(tm.session_summary(base)),
        "funnel": lambda: tm.funnel(events).collect(),
        "funnel_by": lambda: tm.funnel_by(events, users).collect(),
        "retention": lambda: tm.retention(events, users).collect(),
        "retention_by_segment": lambda: tm.retention_by_segment(cohorts, events).collect(),
        "retention_curve": lambda: tm.retention_curve(events, users).collect(),
        "week_one_dropoff": lambda: tm.week_one_dropoff(events, users).collect(),
        "two_proportion_test": lambda: tm.two_proportion_test(users, events).collect(),
        "opportunity": lambda: tm.opportunity(steps, events).collect(),
        "quality_audit": lambda: tm.quality_audit(raw, base).collect(),
        "hour_skew": lambda: quality.hour_skew(base).collect(),
        "dup_keys": lambda: quality.dup_keys(raw).collect(),
    }

    queries = {}
    for run in runs.values():
        run()
    for name, run in runs.items():
        queries[name] = round(statistics.median(timed(run) for _ in range(REPEATS)), 4)
        print(f"{name:24} {queries[name]:.4f}", file=sys.stderr)
    build_models(raw, f"{root}/warm")
    again = [timed(lambda i=i: build_models(raw, f"{root}/models{i}")) for i in range(REPEATS)]
    queries["build_models"] = round(statistics.median(again), 4)
    report(queries, {"raw_events": raw.count(), "stg_events": base.count()})


def report(queries: dict, rows: dict) -> None:
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(queries.values()), 4),
                "unit": "sec",
                "queries": queries,
                "sf": float(os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf") or 0),
                "scale": SCALE,
                "skew": SKEW,
                "rows": rows,
            }
        )
    )


if __name__ == "__main__":
    main()
