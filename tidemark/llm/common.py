"""What the operators share: reading tables, files in the shared folder, Arrow batches."""

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an output batch that a task builds at a time.
BATCH_ROWS = 4096


#: Rows of an Arrow batch: texts are long, and Spark as well as Python hold a batch whole.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches to ``ARROW_ROWS``, for the operators that read texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc32(column: str = "doc_id") -> Column:
    """Unsigned crc32 of an id as text; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, NULL as empty."""
    return [t or "" for t in column.to_pylist()]


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose ``column`` holds about ``limit`` bytes each, one row at least.

    Arrow batches are cut by rows; this keeps what Python unpacks of them bounded when
    texts are long.
    """
    start, total = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def filesystem(uri: str) -> tuple[FileSystem, str]:
    """The file system of a folder's URI or absolute path, and the path within it."""
    return FileSystem.from_uri(uri)


def open_read(fs: FileSystem, path: str) -> pa.NativeFile:
    """A file for random reads: memory-mapped where it is local."""
    if fs.type_name == "local":
        return pa.memory_map(path)
    return fs.open_input_file(path)


def write_json(fs: FileSystem, path: str, value) -> None:
    with fs.open_output_stream(path) as out:
        out.write(json.dumps(value).encode())


def row_struct(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct: helper columns beside it can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
