"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(256 * x), and a score is the inner product of two of them.
Vectors are packed into blocks; a task meets a few blocks of candidates and of queries and
scores all their pairs by matrix products. No score is kept: each pass scores everything anew
and adds up, per query, a histogram of ``BINS`` equal bins over the range that still holds the
kth highest score. The bin that holds it becomes the next range, until every range is one score
wide. A last pass keeps the pairs that reach their query's kth score; ties go to smaller ids.

Within a task, bins below the one where the task's own pairs already reach k can't hold the
global kth score (it is no lower than the kth of any part), so they are not sent; of the pairs
that reach the kth score a task likewise sends the k best by score and id, which is all of its
part that the result can hold. A vector that a third of all rows share therefore costs k rows
per task and query, not a row per copy.

Vectors that are NULL, hold a NULL or non-finite component, or one whose integer is no 64-bit
number (``LIMIT`` or more away from 0) take no part, nor do rows without an id. Scores are exact
over all 64 bits; one that does not fit them is an error, not a row less. Vectors are compared with those of the same length only. Every row whose
id is divisible by ``every`` is a query; rows that have its id are not its candidates. With
fewer than k candidates all of them are returned; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow
from tidemark.sources.tables import materialise, scratch

LIMIT = 1 << 63
BINS = 1024
#: Vectors of a block of candidates, and of queries.
BLOCK = 2048
QUERY_BLOCK = 512
#: Blocks of either kind that meet in one group, and slices of candidates at least.
GROUP_BLOCKS = 16
SLICES = 64
#: The least score.
BOTTOM = -(1 << 63)

BLOCKS = "dim int, block bigint, ids binary, vectors binary"
HISTOGRAM = "dim int, block bigint, place int, bin int, low bigint, high bigint, n bigint"
HITS = "dim int, block bigint, place int, query_id bigint, vec_id bigint, score bigint"


def integer_vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Id, length and integer components of the vectors that take part."""

    def scaled(x: Column) -> Column:
        return 256 * x.cast("double")

    def usable(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float(LIMIT))

    fit = F.coalesce(F.forall(F.col(vector_column), usable), F.lit(False))
    whole = F.transform(F.col(vector_column), lambda x: F.floor(scaled(x)))
    rows = table.filter(F.col(id_column).isNotNull() & fit)
    return rows.select(
        F.col(id_column).cast("bigint").alias("id"), whole.alias("vector"), F.size(vector_column).alias("dim")
    )


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` vectors of one length, made within each partition, saved."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))

        def block(dim: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dim))
            whole = np.concatenate(data)
            small = not whole.size or max(int(whole.max()), -int(whole.min())) < 1 << 31
            row = ([dim], [next(numbers)], [np.concatenate(ids).astype("<i8").tobytes()], [whole.astype("<i4" if small else "<i8").tobytes()])
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds)], names=["dim", "block", "ids", "vectors"]
            )

        for batch in batches:
            for start in range(0, batch.num_rows, rows // 4):
                some = batch.slice(start, rows // 4)
                dims = np.asarray(some.column("dim"))
                for dim in np.unique(dims).tolist():
                    own = some.filter(pa.array(dims == dim))
                    parts = held.setdefault(dim, [])
                    parts.append((np.asarray(own.column("id")), np.asarray(own.column("vector").flatten())))
                    if sum(len(ids) for ids, _ in parts) + rows // 4 > rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return materialise(map_arrow(vectors.select("dim", "id", "vector"), pack, BLOCKS))


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    """The vectors of a block, which has 4 bytes a component, or 8 where one needs them."""
    size = len(raw) // (rows * dim) if rows and dim else 8
    return np.frombuffer(raw, f"<i{size}").reshape(rows, dim).astype("i8")


def _products(queries: np.ndarray, vectors: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where no partial sum can pass 2**53."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), "i8")
    largest = int(np.abs(queries).max()) * int(np.abs(vectors).max())
    if largest * queries.shape[1] < 1 << 53:
        return (queries.astype("f8") @ vectors.astype("f8").T).astype("i8")
    # Right modulo 2**64, and so right where the score fits.
    scores = queries @ vectors.T
    if largest * queries.shape[1] >= 1 << 63:
        _check_fit(queries, vectors, qids[:, None] != ids[None, :])
    return scores


def _check_fit(queries: np.ndarray, vectors: np.ndarray, asked: np.ndarray) -> None:
    """An error if the score of an ``asked`` pair passes 64 bits. Doubles tell for most pairs; the others are summed exactly."""
    a, b = queries.astype("f8"), vectors.astype("f8")
    slack = (np.abs(a) @ np.abs(b).T) * (2 * (queries.shape[1] + 4) * 2.0**-53)
    for i, j in zip(*np.nonzero(asked & (np.abs(a @ b.T) + slack >= 2.0**62))):
        score = sum(x * y for x, y in zip(queries[i].tolist(), vectors[j].tolist()))
        if not BOTTOM <= score < -BOTTOM:
            raise OverflowError(f"a score does not fit 64 bits: {score}")


def _blocks(cells: pa.Table, queries: pa.Table) -> Iterator[tuple[dict, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Each block of queries with its ids, and per block of candidates ids and scores."""
    held = cells.select(["dim", "ids", "vectors"]).to_pylist()
    for query in queries.to_pylist():
        dim, qids = query["dim"], np.frombuffer(query["ids"], "<i8")
        matrix = _matrix(query["vectors"], len(qids), dim)

        def scored():
            for cell in held:
                ids = np.frombuffer(cell["ids"], "<i8")
                yield ids, _products(matrix, _matrix(cell["vectors"], len(ids), dim), qids, ids)

        yield query, qids, scored()


def _count(k: int):
    """Per query the histogram over its range, from the top down to where k scores are reached."""

    def count(cells: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        for query, qids, scored in _blocks(cells, queries):
            low, high = np.array(query["low"], "i8"), np.array(query["high"], "i8")
            # As unsigned numbers, as a range may be all of 64 bits.
            span = (high - low).view("u8")
            width = span // np.uint64(BINS) + np.uint64(1)
            n = len(qids)
            # One bin each for what is below the range (the first) and above it (the last).
            counts = np.zeros((n, BINS + 2), "i8")
            for ids, scores in scored:
                bins = ((scores - low[:, None]).view("u8") // width[:, None]).view("i8") + 1
                bins[scores < low[:, None]] = 0
                bins[scores > high[:, None]] = BINS + 1
                bins[qids[:, None] == ids[None, :]] = 0
                flat = bins + np.arange(n)[:, None] * (BINS + 2)
                counts += np.bincount(flat.ravel(), minlength=counts.size).reshape(counts.shape)
            counts = counts[:, 1:]
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            place, bins = np.nonzero((counts > 0) & (above < k))
            first = bins.astype("u8") * width[place]
            last = np.minimum(first + width[place] - np.uint64(1), span[place])
            parts.append(
                pa.table(
                    {
                        "dim": np.full(len(place), query["dim"], "i4"),
                        "block": np.full(len(place), query["block"], "i8"),
                        "place": place.astype("i4"),
                        "bin": bins.astype("i4"),
                        "low": (low[place].view("u8") + first).view("i8"),
                        "high": (low[place].view("u8") + last).view("i8"),
                        "n": counts[place, bins],
                    }
                )
            )
        return pa.concat_tables(parts) if parts else _empty(HISTOGRAM)

    return count


def _keep(k: int):
    """Per query the pairs that reach its kth score, k at most."""

    def keep(cells: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        for query, qids, scored in _blocks(cells, queries):
            low, found = np.array(query["low"], "i8"), []
            for ids, scores in scored:
                place, at = np.nonzero((scores >= low[:, None]) & (qids[:, None] != ids[None, :]))
                found.append(_best(place, ids[at], scores[place, at], k))
            place, ids, scores = _best(*[np.concatenate(x) for x in zip(*found)], k) if found else (np.empty(0, "i8"),) * 3
            parts.append(
                pa.table(
                    {
                        "dim": np.full(len(place), query["dim"], "i4"),
                        "block": np.full(len(place), query["block"], "i8"),
                        "place": place.astype("i4"),
                        "query_id": qids[place],
                        "vec_id": ids.astype("i8"),
                        "score": scores.astype("i8"),
                    }
                )
            )
        return pa.concat_tables(parts) if parts else _empty(HITS)

    return keep


def _best(place: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, ~scores, place))
    place, ids, scores = place[order], ids[order], scores[order]
    top = np.arange(len(place)) - np.searchsorted(place, place) < k
    return place[top], ids[top], scores[top]


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in fields})


def top_k(
    table: DataFrame,
    k: int = 5,
    every: int = 50,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's k highest scores, saved."""
    with scratch(table.sparkSession):
        return materialise(_top_k(table, k, every, id_column, vector_column), keep=True)


def _top_k(table: DataFrame, k: int, every: int, id_column: str, vector_column: str) -> DataFrame:
    vectors = integer_vectors(table, id_column, vector_column)
    cells = _packed(vectors, BLOCK)
    asked = materialise(vectors.filter(F.col("id") % every == 0))
    n_queries, n_cells = asked.count(), cells.count()
    queries = _packed(asked.repartition(max(1, -(-n_queries // QUERY_BLOCK))), QUERY_BLOCK)
    slices = max(min(n_cells, SLICES), -(-n_cells // GROUP_BLOCKS), 1)
    groups = max(1, -(-queries.count() // GROUP_BLOCKS))

    def dealt(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Every block of queries meets every block of candidates of its length in one group.
    cells = cells.select("*", dealt("block", slices).alias("slice"), each(groups).alias("group"))

    def met(state: DataFrame, function, schema: str) -> DataFrame:
        sides = state.select("*", dealt("block", groups).alias("group"), each(slices).alias("slice"))
        keys = ("dim", "slice", "group")
        return cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(function, schema)

    state = materialise(_first_ranges(queries, vectors))
    wide = F.exists(F.zip_with("high", "low", lambda h, l: h > l), lambda x: x)
    while state.filter(wide).limit(1).count():
        state = materialise(_narrowed(state, met(state, _count(k), HISTOGRAM), k))
    hits = met(state, _keep(k), HITS)
    per_query = Window.partitionBy("dim", "block", "place").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _first_ranges(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds the range of all scores a query may have, both ends included: its sum of absolute
    components times the largest component of any vector, or all 64 bits."""
    largest = vectors.select(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = []
            for row in batch.to_pylist():
                matrix = _matrix(row["vectors"], len(row["ids"]) // 8, row["dim"])
                reach.append([min(sum(v) * largest, -BOTTOM - 1) for v in np.abs(matrix).tolist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[-x - (x == -BOTTOM - 1) for x in r] for r in reach], pa.list_(pa.int64())), pa.array(reach, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "low", "high"],
            )

    return map_arrow(queries, bound, f"{BLOCKS}, low array<bigint>, high array<bigint>")


def _narrowed(state: DataFrame, counted: DataFrame, k: int) -> DataFrame:
    """The state with each query's range cut to the bin that holds its kth score."""
    query = ("dim", "block", "place")
    sums = counted.groupBy(*query, "bin", "low", "high").agg(F.sum("n").alias("n"))
    from_top = Window.partitionBy(*query).orderBy(F.col("bin").desc())
    reached = sums.withColumn("reached", F.sum("n").over(from_top))
    holds = reached.filter((F.col("reached") >= k) & (F.col("reached") - F.col("n") < k))
    ranges = holds.groupBy("dim", "block").agg(
        F.map_from_entries(
            F.collect_list(F.struct("place", F.struct("low", "high")))
        ).alias("ranges")
    )
    # A query that never reaches k has fewer candidates: all of them are its result.
    all_scores = F.struct(F.lit(BOTTOM).alias("low"), F.lit(BOTTOM).alias("high"))
    places = F.sequence(F.lit(0), F.size("low") - 1)
    found = F.transform(places, lambda p: F.coalesce(F.try_element_at(F.col("ranges"), p), all_scores))
    met = state.join(ranges, ["dim", "block"], "left")
    picked = met.select("dim", "block", "ids", "vectors", found.alias("found"))
    return picked.select("dim", "block", "ids", "vectors", F.col("found.low").alias("low"), F.col("found.high").alias("high"))
