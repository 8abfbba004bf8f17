"""Packing documents into training sequences: concatenate and cut.

The first pass encodes every document once and saves its ids with the task, its place there
and the ids before it in that task. The tasks' totals, one row per task, are summed up to give
the base of each task, so that every document has its offset in the concatenation of all. The
second pass reads the saved ids and cuts them at multiples of the sequence length; the pieces
are the boundary records. Documents stay in the order of the table, so a table that was
shuffled before is packed as shuffled, and nothing but the tasks' totals is moved.

All sequences but the last are full. ``sequences`` pads the last one to the sequence length,
unless its length is a power of two.

A NULL text is empty: its document is the end id alone. Rows that share an id are documents of
their own. An empty table has no pieces.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices, texts_of
from tidemark.llm.encoding import encoder
from tidemark.sources.tables import materialise

SEQUENCE = 2048
TOKENS = "part int, before bigint, doc_id bigint, n_tokens bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, ids binary"
)


def token_table(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """First pass, saved: ids of every document, the task that wrote it, the ids before it there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype).astype("<u4").astype(coder.dtype).tobytes()
        width = coder.dtype.itemsize
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                ids = [coder.encode(t).tobytes() + end for t in texts_of(piece.column("text"))]
                lengths = np.array([len(x) // width for x in ids], "i8")
                starts = before + np.cumsum(lengths) - lengths
                before += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, "i4")),
                        pa.array(starts),
                        piece.column("doc_id"),
                        pa.array(lengths),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "before", "doc_id", "n_tokens", "ids"],
                )

    picked = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")
    )
    return materialise(map_arrow(picked, encode, TOKENS))


def cut(tokens: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Second pass: one row per piece, its ids as little-endian unsigned 32-bit integers."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("base"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "ids", 4 << 20):
                yield _pieces(some, length)

    # One row per task of the first pass, whatever the size of the table.
    placed = tokens.join(F.broadcast(materialise(bases)), "part").select(
        (F.col("base") + F.col("before")).alias("at"), "doc_id", "n_tokens", "ids"
    )
    return map_arrow(placed, pieces, PIECES)


def _pieces(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    at = np.asarray(batch.column("at"), "i8")
    n = np.asarray(batch.column("n_tokens"), "i8")
    first, last = at // length, (at + n - 1) // length
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(sequence * length, at[row])
    end = np.minimum((sequence + 1) * length, (at + n)[row])
    start = begin - at[row]
    ids, cut_ids = batch.column("ids"), []
    for i, (a, b) in enumerate(zip(np.cumsum(count) - count, np.cumsum(count))):
        raw = ids[i].as_buffer()
        own = np.frombuffer(raw, f"<u{raw.size // int(n[i])}").astype("<u4")
        cut_ids += [own[s : s + k].tobytes() for s, k in zip(start[a:b], (end - begin)[a:b])]
    columns = [
        batch.column("doc_id").take(pa.array(row)),
        pa.array(start),
        pa.array(end - begin),
        pa.array(n[row]),
        pa.array(sequence),
        pa.array(begin - sequence * length),
        pa.array(cut_ids, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(
        columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, length: int = SEQUENCE, **columns: str) -> DataFrame:
    """The pieces of all documents."""
    return cut(token_table(docs, tokenizer_path, end_id, **columns), length)


def sequences(pieces: DataFrame, pad_id: int = 0, length: int = SEQUENCE) -> DataFrame:
    """One row per sequence: its ids as little-endian unsigned 32-bit integers, padded, and
    ``n_tokens`` without the padding. A group holds at most ``length`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, p: F.concat(all_, p["ids"]))
    rows = pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
    n = F.col("n_tokens")
    short = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(length))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (short - n).cast("int")))
    return rows.select("sequence_id", "n_tokens", F.concat("ids", pad).alias("ids"))
