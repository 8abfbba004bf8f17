"""Session settings the results depend on; sizing is left to the cluster."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Dates, hours and weeks of zoned timestamps follow the session zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording a call site for every column costs more than planning small queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

#: Parquet's nanosecond timestamps as numbers, which ``read_events`` turns into timestamps.
NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def build_session(
    app_name: str = "tidemark", master: str | None = None, nanos: bool = False, **conf
) -> SparkSession:
    """A session with the settings above; ``conf`` adds or overrides (dots as ``__``). With
    ``nanos`` every nanosecond timestamp of the session is read as a number."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if nanos:
        builder = builder.config(NANOS, "true")
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
