"""Verdicts on rows, brought back to their texts as one bit per row: texts never shuffle, at any size.

Rows are saved with their places, which run through each file; what decides on them are slim rows
with a place. The places decided on become bitmaps, one for a run of 32,768 places, and meet the saved
rows in a broadcast join, in the task that reads the rows' file. As many runs as fit the limit are
sent along at a time; beyond it the files are taken in groups, each read once with its own bits.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_struct
from tidemark.sources.tables import materialise, scratch_dir, shared_dir

#: Bits of a bitmap, as the bitmap functions of Spark have them (4,096 bytes).
BLOCK_BITS = 32768
#: What is broadcast of the bitmaps at a time.
BROADCAST_BYTES = 32 << 20
#: A place is the file in its upper bits and the row within it in the lower 33; a run is as many
#: places as a bitmap has bits.
PLACE_BITS, RUN_BITS = 33, 15


def save_placed(docs: DataFrame, keep: bool = True) -> DataFrame:
    """``docs`` saved as a struct ``doc`` and each row's ``place``."""
    return materialise(docs.select(row_struct(docs, "doc"), F.monotonically_increasing_id().alias("place")), keep)


def bit_set(position: Column) -> Column:
    """Whether the bit at ``position`` of ``bitmap`` is set."""
    byte = F.substring("bitmap", (F.floor(position / 8) + 1).cast("int"), F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.expr("1").bitwiseAND(F.call_function("shiftright", value, position % 8)) == 1


def meet(
    placed: DataFrame,
    marks: DataFrame,
    then: Callable[[DataFrame], DataFrame],
    limit: int = BROADCAST_BYTES,
    keep: bool = False,
) -> DataFrame:
    """``then`` of the rows of ``placed`` with a column ``hit``: whether ``marks`` has their place.
    ``limit`` bounds the bytes of bits that are broadcast at a time; ``keep`` is for a result
    that outlives the ``scratch`` block that runs."""
    run, bit = F.shiftright("place", RUN_BITS), F.col("place").bitwiseAND(F.lit(BLOCK_BITS - 1))
    keyed = marks.select(run.alias("run"), bit.alias("bit")).groupBy("run")
    bits = materialise(keyed.agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")), keep)

    def group(rows: DataFrame, some: DataFrame) -> DataFrame:
        met = rows.withColumn("run", run).join(F.broadcast(some), "run", "left")
        return then(met.select(*rows.columns, F.coalesce(bit_set(bit), F.lit(False)).alias("hit")))

    parts = _groups_of_files(bits, limit)
    if len(parts) < 2:
        return group(placed, bits)
    spark = placed.sparkSession
    root = shared_dir(spark) if keep else scratch_dir(spark)
    paths = [f"{root}/{i}-{uuid.uuid4().hex}" for i in range(len(parts))]
    for path, (first, last) in zip(paths, parts):  # one after the other: each frees its broadcast
        # By place, so that the files of other groups are left out by their statistics.
        rows = placed.filter(F.col("place").between(first << PLACE_BITS, (last + 1 << PLACE_BITS) - 1))
        shift = PLACE_BITS - RUN_BITS
        found = group(rows, bits.filter(F.col("run").between(first << shift, (last + 1 << shift) - 1)))
        found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(*paths)


def _groups_of_files(bits: DataFrame, limit: int) -> list[tuple[int, int]]:
    """First and last number of consecutive files whose bits come to ``limit`` bytes at most, or to
    one file's; together they are all files. The driver sees one row per file."""
    file = F.shiftright("run", PLACE_BITS - RUN_BITS)
    sizes = bits.groupBy(file.alias("file")).agg(F.count("*").alias("n")).collect()
    starts, used = [], 0
    for number, n in sorted(sizes):
        size = n * (BLOCK_BITS // 8)
        if starts and used + size <= limit:
            used += size
        else:
            starts.append(number)
            used = size
    starts = [0, *starts[1:]]
    return list(zip(starts, [*[s - 1 for s in starts[1:]], (1 << 63 - PLACE_BITS) - 1]))
