"""Physical layouts of the clean events, their sizes, and the one-day query they serve."""

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.numbers import ratio
from tidemark.sources.tables import materialise

NARROW_COLUMNS = ("user_id", "event_name", "event_ts")


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_base(events: DataFrame, path: str) -> None:
    """All columns, as they come."""
    _write(events, path)


def write_clustered(events: DataFrame, path: str) -> None:
    """Sorted by user and time. Ranges over both columns cut a very active user into
    several files instead of one."""
    order = ("user_id", "event_ts")
    _write(events.repartitionByRange(*order).sortWithinPartitions(*order), path)


def write_narrow(events: DataFrame, path: str) -> None:
    """Only the columns funnel counts read."""
    _write(events.select(*NARROW_COLUMNS), path)


def write_by_date(events: DataFrame, path: str) -> None:
    """One folder per event date, so a filter on the date lists only its files.

    Rebalancing lets adaptive execution cut a busy date into several files and put quiet
    dates into one task, whatever the number of shuffle partitions.
    """
    by_date = events.hint("rebalance", "event_date")
    _write(by_date.sortWithinPartitions("event_date", "user_id"), path, "event_date")


def add_to_dates(events: DataFrame, path: str, key: str = "event_id") -> list[date]:
    """Adds ``events`` to the by-date layout at ``path``, in place of rows with the same ``key`` on
    the same date, and returns the dates. Only their folders are written anew; the files of all
    other dates stay as they are.

    The new folders are complete before the old ones go, date by date. Rows without a date have a
    folder of their own.
    """
    spark = events.sparkSession
    dates = sorted((r[0] for r in events.select("event_date").distinct().collect()), key=lambda d: (d is None, d))
    if not dates:
        return []
    named = [d for d in dates if d is not None]
    touched = F.col("event_date").isin(*named) if named else F.lit(False)
    if None in dates:
        touched = touched | F.col("event_date").isNull()
    known = spark.read.schema(events.schema).parquet(path).filter(touched)
    same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in (key, "event_date")]
    kept = known.alias("old").join(events.select(key, "event_date").distinct().alias("new"), same, "left_anti")
    # Saved first: the folders that it reads are about to be replaced.
    merged = materialise(kept.unionByName(events))
    by_date = merged.hint("rebalance", "event_date").sortWithinPartitions("event_date", "user_id")
    writer = by_date.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy("event_date").parquet(path)
    return dates


def write_bucketed(events: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A catalog table of all columns in ``buckets`` files by user, sorted by user and time, and what
    it reads. Funnels, retention, sessions and first touches of it group by user where the rows lie,
    without a shuffle of events; two such tables join the same way. Each file is a user's as a
    whole, so a busy one makes a large file: ``write_clustered`` spreads it instead."""
    order = ("user_id", "event_ts")
    dealt = events.repartition(buckets, "user_id")
    writer = dealt.write.mode("overwrite").option("compression", "zstd").option("path", path)
    writer.bucketBy(buckets, "user_id").sortBy(*order).saveAsTable(table)
    return events.sparkSession.table(table)


LAYOUTS = {
    "base": write_base,
    "clustered": write_clustered,
    "narrow": write_narrow,
    "by_date": write_by_date,
}


def write_layouts(events: DataFrame, root: str) -> dict[str, str]:
    """Writes every layout under ``root`` and returns the path of each."""
    paths = {name: f"{root.rstrip('/')}/{name}" for name in LAYOUTS}
    for name, write in LAYOUTS.items():
        write(events, paths[name])
    return paths


def _opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A layout; one that has no file, as folders by date of no rows, with the given schema."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.read.schema(schema).parquet(path)


def layout_sizes(spark: SparkSession, paths: Mapping[str, str], base: str = "base") -> DataFrame:
    """Per layout: parquet bytes, rows, columns, and bytes against the ``base`` layout. Bytes are
    those of files that hold rows: 0, and NULL against the base, for an empty table."""
    measured = []
    schema = spark.read.parquet(paths[base]).schema
    for name, path in paths.items():
        table = _opened(spark, path, schema)
        files = table.groupBy("_metadata.file_path", "_metadata.file_size").agg(
            F.count("*").alias("n")
        )
        measured.append(
            files.agg(
                F.coalesce(F.sum("file_size"), F.lit(0)).alias("parquet_bytes"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            )
            .withColumn("column_count", F.lit(len(table.columns)))
            .select(F.lit(name).alias("layout"), "parquet_bytes", "row_count", "column_count")
        )
    sizes = reduce(DataFrame.unionByName, measured)
    base_bytes = sizes.filter(F.col("layout") == base).select("parquet_bytes").scalar()
    return sizes.withColumn("bytes_vs_base", ratio(F.col("parquet_bytes"), base_bytes, 3))


def day_slice(events: DataFrame, day: date) -> DataFrame:
    """Events and distinct users on one date.

    Filters the stored date where there is one, which prunes folders of the by-date
    layout, and otherwise the timestamp, which Spark pushes to parquet as a range.
    """
    on: Column = F.col("event_date") if "event_date" in events.columns else F.to_date("event_ts")
    return events.filter(on == F.lit(day)).agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users")
    )
