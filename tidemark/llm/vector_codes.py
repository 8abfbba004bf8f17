"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry.

Vectors are cut into equal consecutive parts of integer components, and every part position has
a codebook of a few entries, learned in rounds: each part goes to its nearest entry (least squared
distance, the lower number on a tie), then each entry becomes the componentwise mean of its
parts, rounded down. Everything is integer arithmetic, so the result depends neither on the order of
rows nor on how they are dealt out.

Distances come from value dictionaries. Vectors are saved once as blocks; a block has, per
dimension, the distinct integers that occur there and a 16-bit code per vector. A round tabulates the
squared differences of every distinct integer to that dimension's component of all entries; the
distances of a part are rows of those tables, gathered by code and added. The sums of an entry
are counts of its codes times the integers. A task sends one row per entry and component, which are
added up in a shuffle; the driver holds codebooks only (entries x dimensions numbers).

A vector that is NULL or holds a NULL or non-finite component takes no part. All others must have
one length, a multiple of the number of parts, and components whose squared distances fit 63
bits (about 46,000 for 64 dimensions); others raise an error. Rows without an id come last among the
first entries; rows that share an id each take part, and vectors that are equal share code and
error. NULL labels are one label. Columns other than id, vector and label are not read. No
vectors at all give an empty result, and fewer than ``entries`` of them as many entries.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.sources.tables import materialise, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A block's components; with 65,536 rows at most a code takes 16 bits.
BLOCK_CELLS, BLOCK_ROWS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Codebooks:
    """``entries``: part x entry x position within the part."""

    entries: np.ndarray
    scale: float

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector a code stands for: the lower corners of its entries' components."""
        picked = [part[n] for part, n in zip(self.entries, bytes.fromhex(code))]
        return np.concatenate(picked) / self.scale


def _finite(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def _integers(values: np.ndarray, scale: float, dims: int) -> np.ndarray:
    """Components as integers; their squared distances over a vector fit 63 bits."""
    scaled = np.floor(values * scale)
    most = isqrt((1 << 63) // (4 * max(1, dims))) - 1
    if len(scaled) and np.abs(scaled).max(initial=0) > most:
        raise OverflowError(f"a component beyond {most / scale:g}: distances would not fit 63 bits")
    return scaled.astype("i8")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dims).any():
        raise ValueError(f"vectors of {dims} components were expected, one has {lengths[lengths != dims][0]}")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)


def save_blocks(kept: DataFrame, dims: int, scale: float) -> DataFrame:
    """Rows of up to ``BLOCK_ROWS`` vectors each: ids, labels, sizes and values of the
    dimensions' dictionaries, and the codes, dimension by dimension."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, dims)))
    schema = kept.schema
    kinds = [schema[c].dataType.simpleString() for c in ("id", "label")]

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        ids, labels, vectors = (table.column(c).combine_chunks() for c in ("id", "label", "vector"))
        cells = _integers(_matrix(vectors, dims), scale, dims)
        found = [np.unique(cells[:, d], return_inverse=True) for d in range(dims)]
        codes = np.array([codes for _, codes in found], "<u2")
        values = np.concatenate([values for values, _ in found] or [np.empty(0)]).astype("<i8")
        ends = pa.array([0, table.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(ends, ids),
                pa.ListArray.from_arrays(ends, labels),
                pa.array([[len(values) for values, _ in found]], pa.list_(pa.int32())),
                pa.array([values.tobytes()], pa.binary()),
                pa.array([codes.tobytes()], pa.binary()),
            ],
            ["ids", "labels", "sizes", "dictionary", "codes"],
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, rows - n)
                held.append(piece)
                n += piece.num_rows
                batch = batch.slice(piece.num_rows)
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return materialise(
        map_arrow(
            kept, cut, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, sizes array<int>, dictionary binary, codes binary"
        )
    )


class _Block:
    """The dictionaries of a block and its codes (dimension x vector)."""

    def __init__(self, sizes: list[int], dictionary: bytes, codes: bytes, rows: int):
        values = np.frombuffer(dictionary, "<i8")
        self.values = np.split(values, np.cumsum(sizes)[:-1]) if sizes else []
        self.codes = np.frombuffer(codes, "<u2").reshape(len(sizes), rows)
        self.rows = rows

    def nearest(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per part and vector the number of the nearest entry and its squared distance."""
        parts, entries, width = books.shape
        number, least = np.zeros((parts, self.rows), "i8"), np.zeros((parts, self.rows), "i8")
        for p in range(parts):
            far = np.zeros((self.rows, entries), "i8")
            for j in range(width):
                d = p * width + j
                table = (self.values[d][:, None] - books[p, None, :, j]) ** 2
                far += table[self.codes[d]]
            number[p] = far.argmin(axis=1)
            least[p] = far[np.arange(self.rows), number[p]]
        return number, least

    def sums(self, number: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry its vectors; per part, position and entry their components' sum."""
        parts = len(number)
        width = len(self.values) // parts
        counts = np.array([np.bincount(n, minlength=entries) for n in number], "i8")
        totals = np.zeros((parts, width, entries), "i8")
        for d, values in enumerate(self.values):
            pairs = number[d // width] * len(values) + self.codes[d]
            tally = np.bincount(pairs, minlength=entries * len(values)).reshape(entries, -1)
            totals[d // width, d % width] = tally @ values
        return counts, totals


def _blocks(batch: pa.RecordBatch, *lists: str) -> Iterator[tuple]:
    """The blocks of a batch, each with its ``lists`` as Arrow arrays."""
    for i in range(batch.num_rows):
        row = batch.slice(i, 1)
        taken = [row.column(c).flatten() for c in lists]
        sizes, dictionary, codes = (row.column(c)[0].as_py() for c in ("sizes", "dictionary", "codes"))
        rows = len(codes) // (2 * len(sizes)) if sizes else len(taken[0]) if taken else 0
        yield _Block(sizes, dictionary, codes, rows), *taken


def learn(blocks: DataFrame, first: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """``first`` after so many rounds over all blocks."""
    books = first.entries.copy()
    parts, entries, width = books.shape
    for _ in range(rounds if width else 0):

        def tally(batches: Iterator[pa.RecordBatch], books: np.ndarray = books.copy()) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros((parts, entries), "i8"), np.zeros((parts, width, entries), "i8")
            for batch in batches:
                for (block,) in _blocks(batch):
                    more = block.sums(block.nearest(books)[0], entries)
                    counts += more[0]
                    totals += more[1]
            p, j, e = (x.ravel() for x in np.indices(totals.shape, dtype="i4"))
            used = counts[p, e] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[used]) for x in (p, e, j, counts[p, e], totals.ravel())], ["part", "entry", "place", "n", "total"]
            )

        slim = blocks.select("sizes", "dictionary", "codes")
        sent = map_arrow(slim, tally, "part int, entry int, place int, n bigint, total bigint")
        # One row per entry and component: as many as the codebooks have numbers.
        added = sent.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for part, entry, place, n, total in added.collect():
            books[part, entry, place] = total // n
    return Codebooks(books, first.scale)


def encode(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``id``, ``label``, ``code`` and ``error`` of every vector."""
    schema = blocks.schema
    kinds = [schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, labels in _blocks(batch, "ids", "labels"):
                number, least = block.nearest(books.entries)
                digits, width = number.T.astype("u1").tobytes().hex(), 2 * len(number)
                codes = [digits[i : i + width] for i in range(0, len(digits), width)]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(codes, pa.string()), pa.array(least.sum(axis=0))], ["id", "label", "code", "error"]
                )

    return map_arrow(blocks, assign, f"id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, Codebooks]:
    """``id``, ``label``, ``code``, ``error`` and ``label_error`` (the errors of the row's label
    added up) of every vector, and the codebooks. The first entries are the parts of the vectors
    with the smallest ids, the smaller vector first where ids are equal."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits: 1 to 256 entries")
    read = vectors.select(
        F.col(id_column).alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    )
    kept = read.filter(_finite(F.col("vector")))
    head = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    dims = len(head[0].vector) if head else 0
    if dims % parts or any(len(r.vector) != dims for r in head):
        raise ValueError(f"vectors need one length, a multiple of {parts}")
    rows = _integers(np.array([r.vector for r in head], "f8").reshape(len(head), dims), scale, dims)
    books = Codebooks(rows.reshape(len(head), parts, dims // parts).transpose(1, 0, 2).copy(), scale)
    with scratch(vectors.sparkSession):
        blocks = save_blocks(kept, dims, scale)
        books = learn(blocks, books, rounds) if head else books
        coded = materialise(encode(blocks, books), keep=True)
        # Saved, so that the join is planned on its true size; a hot label can then be split.
        errors = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
        errors = materialise(errors, keep=True)
    found = coded.join(errors, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return found, books
