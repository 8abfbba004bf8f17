"""Token ids in flat binary files with 64-bit document offsets, for memory-mapped training.

Documents are range-partitioned by id and a hash of the text, so that an id of many rows spreads
over files, and sorted likewise. Each task writes two files to the shared
folder: ``.bin`` holds the ids of its documents one after the other, as little-endian unsigned
integers of the smallest type that holds the vocabulary; ``.idx`` holds the file magic, the
number of documents and the bytes of an id, then n + 1 offsets (ids before each document), n
document ids (64 bits each) and n bytes that are 1 where the id is NULL. The tasks' totals are
saved as the manifest, a table with one row per pair of files, whose prefix sums give the base
of each file in the whole sequence.

File names are unique per attempt and only files of the manifest, which Spark commits, are
ever read: a lost executor or a second attempt leaves no trace in the result.

A NULL text is empty (its document holds only the end id), NULL ids come first, rows that share
an id are ordered by the hash of their text, an empty table gives no files and no rows.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, filesystem, map_arrow, open_read, slices, texts_of
from tidemark.llm.encoding import encoder
from tidemark.sources.tables import materialise

MAGIC = b"TDMKIDX1"
HEADER = 24
MANIFEST = "part int, file string, first_null boolean, n_docs bigint, n_tokens bigint"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def write_token_files(
    docs: DataFrame,
    root: str,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Writes the files under ``root`` and returns the manifest with each file's ``base``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        coder, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        name = f"{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], coder.dtype)
        if int(end[0]) != end_id:
            raise ValueError(f"{end_id} does not fit {coder.dtype}")
        lengths, ids, out = [], [], None
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}.bin")
                ids.append(piece.column("doc_id"))
                for text in texts_of(piece.column("text")):
                    tokens = coder.encode(text)
                    lengths.append(len(tokens) + 1)
                    out.write(tokens.tobytes())
                    out.write(end.tobytes())
        if out is None:
            return
        out.close()
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<i8")]).astype("<i8")
        doc_ids = pa.concat_arrays(ids)
        known = np.asarray(doc_ids.is_valid())
        with fs.open_output_stream(f"{path}/{name}.idx") as index:
            index.write(MAGIC + np.array([len(lengths), coder.dtype.itemsize], "<u8").tobytes())
            index.write(offsets.tobytes())
            index.write(np.asarray(doc_ids.fill_null(0), "<i8").tobytes())
            index.write((~known).astype("u1").tobytes())
        row = [[part], [name], [bool(not known[0])], [len(lengths)], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64()))],
            names=["part", "file", "first_null", "n_docs", "n_tokens"],
        )

    picked = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")
    )
    # Not by the text itself: the driver samples what rows are dealt by.
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = picked.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    files = materialise(map_arrow(ordered, write, MANIFEST))
    # One row per task: the prefix sum is over as many rows as there are files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    return materialise(files.select("*", base))


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens
    and ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(root)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(fs, f"{path}/{row['file']}", row["base"])

    return map_arrow(manifest.repartition(max(1, manifest.count())), read, DOCUMENTS)


def _documents(fs, path: str, base: int) -> Iterator[pa.RecordBatch]:
    with open_read(fs, f"{path}.idx") as index, open_read(fs, f"{path}.bin") as tokens:
        header = index.read_at(HEADER, 0)
        if header[:8] != MAGIC:
            raise ValueError(f"{path}.idx is no index of token ids")
        n, width = (int(x) for x in np.frombuffer(header[8:], "<u8"))
        kind = np.dtype(f"<u{width}")

        def column(dtype: str, start: int, first: int, count: int) -> np.ndarray:
            size = np.dtype(dtype).itemsize
            return np.frombuffer(index.read_at(count * size, start + first * size), dtype)

        for first in range(0, n, BATCH_ROWS // 8):
            count = min(BATCH_ROWS // 8, n - first)
            offsets = column("<i8", HEADER, first, count + 1)
            doc_ids = column("<i8", HEADER + 8 * (n + 1), first, count)
            unknown = column("u1", HEADER + 8 * (2 * n + 1), first, count).astype(bool)
            ids = []
            for a, b in zip(offsets, offsets[1:]):
                raw = tokens.read_at(int(b - a) * width, int(a) * width)
                ids.append(np.frombuffer(raw, kind).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64(), mask=unknown),
                    pa.array(base + offsets[:-1], pa.int64()),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )
