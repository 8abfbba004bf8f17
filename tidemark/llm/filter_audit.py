"""How filters interact: what each removes at its step in every order they can be applied in.

A row's failures are a bit mask, one bit per filter. Rows are counted per part and mask, so what
is left to work out is at most ``2 ** k`` masks a part, however many rows there are. The step at
which a mask goes in an order is a min-plus product: the mask's row (0 where it fails, never
where it passes) meets the order's column of positions, which is its inverse permutation, and the
least sum is the first filter of the order that the mask fails. That step says where the mask's
counts are added, as removed rows at the step itself and as redundant failures at every later
filter it fails too.

The filters of documents (``document_failures``):

- A: fewer than 200 words, B: fewer than half of the words distinct, C: over 3 % of the code
  points in A-Z, D: holds one of ``#$%&*|``;
- E: the same text as a row with a smaller id, wherever that row is and whatever it fails itself.

A NULL text counts as empty and equals one; a NULL part is the empty string. Rows that share id and
text are not copies of a smaller id; a row without an id is no copy and no row's original, and has no label.
An id that ``labels`` holds repeatedly is good or toxic if one of its rows says so. A text of any
length is read whole, a megabyte of words at a time. Only the columns named are read, whatever
others there are. An empty table has no parts and gives no rows.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices
from tidemark.sources.tables import materialise, scratch

#: The document filters in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
CAPITALS = bytes(range(0x41, 0x5B))
MARKS = b"#$%&*|"
#: UTF-8 bytes that do not start a code point.
INNER_BYTES = bytes(range(0x80, 0xC0))
SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes whose words are held at a time.
PART_BYTES = 1 << 20
WEIGHTS = ("n", "good", "toxic")


def word_counts(raw: bytes, part: int = PART_BYTES) -> tuple[int, int]:
    """Words and distinct words of a text; ``bytes.split`` cuts at the same six characters."""
    total, seen, start = 0, set(), 0
    while start < len(raw):
        cut = SPACE.search(raw, start + part)
        end = cut.start() if cut else len(raw)
        words = raw[start:end].split()
        total += len(words)
        seen.update(words)
        start = end
    return total, len(seen)


def own_mask(raw: bytes) -> int:
    """The bits of A to D, which a text fails or passes by itself."""
    words, distinct = word_counts(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    code_points = len(raw.translate(None, INNER_BYTES))
    fails = (
        words < MIN_WORDS,
        100 * distinct < MIN_DISTINCT_PERCENT * words,
        100 * capitals > MAX_CAPITAL_PERCENT * code_points,
        len(raw.translate(None, MARKS)) < len(raw),
    )
    return sum(1 << bit for bit, fail in enumerate(fails) if fail)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            raws = piece.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id"),
                    piece.column("part"),
                    pa.array([own_mask(raw or b"") for raw in raws], pa.int32()),
                    pa.array([hashlib.sha256(raw or b"").digest() for raw in raws], pa.binary()),
                ],
                ["id", "part", "mask", "digest"],
            )


def document_failures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang"
) -> DataFrame:
    """``id``, ``part`` and ``mask`` of every row of ``docs``, saved. Texts are read once and
    shuffle as digests only; those of a repeated text meet its least id in a join that a hot text
    may be split in."""
    part = F.coalesce(F.col(part_column).cast("string"), F.lit(""))
    read = docs.select(F.col(id_column).alias("id"), part.alias("part"), F.col(text_column).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    with scratch(docs.sparkSession):
        own = materialise(map_arrow(read, _masks, f"id {kind}, part string, mask int, digest binary"))
        repeated = own.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
        repeated = materialise(repeated.select("digest", "least"))
        copy = F.when(F.col("id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0)
        masked = own.join(repeated, "digest", "left").select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))
        return materialise(masked, keep=True)


def weigh(masked: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per ``part`` and ``mask``: rows ``n``, those labelled ``good`` (quality 1) and ``toxic``."""
    flags = (
        labels.groupBy(F.col(id_column).alias("id"))
        .agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
        .filter("id is not null and good + toxic > 0")
    )
    nothing = F.lit(0).cast("bigint")
    rows = masked.groupBy("part", "mask").agg(F.count("*").alias("n"))
    labelled = masked.join(flags, "id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return (
        rows.select("part", "mask", "n", nothing.alias("good"), nothing.alias("toxic"))
        .unionByName(labelled.select("part", "mask", nothing.alias("n"), "good", "toxic"))
        .groupBy("part", "mask")
        .agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    )


@cache
def removal_steps(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All orders of ``k`` filters (order x step), the position of each filter in them (filter x
    order), and the step at which each mask goes (mask x order), ``k`` where it stays."""
    orders = np.array(list(permutations(range(k))), "i8")
    position = np.argsort(orders, axis=1).T
    fails = (np.arange(1 << k)[:, None] >> np.arange(k)) & 1
    never = np.where(fails == 1, 0, k)
    return orders, position, np.minimum((never[:, :, None] + position[None]).min(axis=1), k)


def interactions(counts: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The result of one part as arrays of order x step, from its weights x masks."""
    orders, position, steps = removal_steps(k)
    each = np.arange(len(orders))
    gone = np.zeros((len(WEIGHTS), len(orders), k + 1), "i8")
    redundant = np.zeros((len(orders), k), "i8")
    for mask in range(1 << k):
        gone[:, each, steps[mask]] += counts[:, mask, None]
        for f in range(k):
            if mask >> f & 1:
                late = position[f] > steps[mask]
                redundant[each[late], position[f][late]] += counts[0, mask]
    removed, good, toxic = gone[:, :, :k]
    alone = counts[0, 1 << np.arange(k)]
    summed = np.array([removed[each, position[f]].sum() for f in range(k)], "i8")
    return {
        "kept": counts[0].sum() - removed.cumsum(axis=1),
        "removed": removed,
        "redundant": redundant,
        "unique_fails": alone[orders],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": summed[orders],
    }


def audit(weighed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, from the result of ``weigh``. A part meets
    a task as one row of three arrays with a number per mask. ``k`` filters have ``k!`` orders."""
    k = len(filters)
    names = ["".join(filters[f] for f in order) for order in removal_steps(k)[0].tolist()]
    arrays = [
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(w))), F.lit(0)) for m in range(1 << k)]).alias(w)
        for w in WEIGHTS
    ]
    result = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = pa.array(np.repeat(names, k))
        step = pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(names)))
        for batch in batches:
            for row in batch.to_pylist():
                found = interactions(np.array([row[w] for w in WEIGHTS], "i8"), k)
                part = pa.array([row["part"]] * len(order), pa.string())
                columns = [pa.array(found[c].ravel()) for c in result]
                yield pa.RecordBatch.from_arrays([part, order, step, *columns], ["part", "filter_order", "step", *result])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in result)
    return map_arrow(weighed.groupBy("part").agg(*arrays), spread, schema)
