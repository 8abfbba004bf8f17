"""Reading events, saving tables and views, writing results."""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import cache
from urllib.parse import urlparse

from py4j.java_gateway import JavaObject
from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tidemark import defaults
from tidemark.session import NANOS
from tidemark.sources.versions import save_table


def as_events(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with the event columns, taken from other names where ``columns`` says so."""
    return df.select(*[F.col(columns.get(c, c)).alias(c) for c in defaults.EVENT_COLUMNS])


def _nanos_schema(spark: SparkSession, path: str) -> StructType:
    """The schema of a file with nanosecond timestamps, those as numbers: asked for in a session of
    its own, so that the caller's reads other files as before."""
    probe = spark.newSession()
    probe.conf.set(NANOS, "true")
    return probe.read.parquet(path).schema


def read_events(spark: SparkSession, path: str, **columns: str) -> DataFrame:
    """Events from parquet, with timestamps of any unit. Spark has none finer than microseconds:
    where ``event_ts`` is in nanoseconds it is read as a number and rounded down. The files of one
    ``path`` have one unit; another path may have another, in the same session."""
    try:
        return as_events(spark.read.parquet(path), **columns)
    except AnalysisException as error:
        if error.getCondition() != "PARQUET_TYPE_ILLEGAL":
            raise
    events = as_events(spark.read.schema(_nanos_schema(spark, path)).parquet(path), **columns)
    if isinstance(events.schema["event_ts"].dataType, LongType):
        micros = F.expr("event_ts div 1000 - if(event_ts % 1000 < 0, 1, 0)")
        events = events.withColumn("event_ts", F.timestamp_micros(micros))
    return events


def _write(df: DataFrame, path: str) -> DataFrame:
    """``df`` as ZSTD parquet in a folder that nobody else knows yet."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


#: Folders that this process made and has not removed, with the Hadoop settings to reach them by.
_made: dict[str, JavaObject | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which every executor can reach.

    Only in local mode, where one machine is the whole cluster, may the setting be absent.
    The folder is this process's own and goes when it ends, or earlier by ``remove_dir``.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.startswith("local"):
        root = _local_dir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = f"{root.rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    _made[path] = spark._jsc.hadoopConfiguration() if hasattr(spark, "_jsc") else None
    return path


def remove_dir(path: str) -> None:
    """Removes a folder that ``shared_dir`` named, if anything was written there. The session may
    have stopped since; a folder that can't be removed is not forgotten."""
    if path not in _made:
        raise ValueError(f"{path} was not made by this process")
    where = urlparse(path)
    if where.scheme in ("", "file"):
        shutil.rmtree(where.path, ignore_errors=True)
    elif (conf := _made[path]) is not None:  # the JVM outlives the session
        folder = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    del _made[path]


@atexit.register
def _remove_all() -> None:
    """One folder that can't be removed does not keep the others."""
    for path in list(_made):
        with suppress(Exception):
            remove_dir(path)


class Workspace:
    """Tables in a shared folder that go when the ``with`` block ends, or by ``drop``."""

    def __init__(self, spark: SparkSession):
        self.root = shared_dir(spark)

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` saved under ``name``; a table of that name is replaced."""
        if name is None:
            return _write(df, f"{self.root}/{uuid.uuid4().hex}")
        return save_table(df, f"{self.root}/{name}")

    def drop(self) -> None:
        if self.root in _made:
            remove_dir(self.root)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_) -> None:
        self.drop()


#: Where ``materialise`` saves while a ``scratch`` block runs.
_scope: ContextVar[Workspace | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Workspace]:
    """Tables that ``materialise`` saves within the block go at its end, but for those it keeps."""
    space = Workspace(spark)
    token = _scope.set(space)
    try:
        yield space
    finally:
        _scope.reset(token)
        space.drop()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path that goes with the ``scratch`` block that runs, else one of the program's."""
    space = _scope.get()
    return f"{space.root}/{uuid.uuid4().hex}" if space else shared_dir(spark)


def materialise(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, read by many, safe to lose
    executors over. ``keep`` saves it beyond the ``scratch`` block that runs."""
    space = _scope.get()
    if space and not keep:
        return space.save(df)
    return _write(df, shared_dir(df.sparkSession))


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Makes each table readable from SQL under its name."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def write_json(df: DataFrame, path: str) -> None:
    """Writes a result as JSON lines; NaN becomes NULL and NULL fields are kept."""
    numbers = [name for name, kind in df.dtypes if kind in ("double", "float")]
    plain = df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in numbers}) if numbers else df
    plain.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
