"""Near-duplicate documents by a size-aware heavy-light join on the Jaccard similarity of their
sets of word shingles; exact for shingles as 64-bit numbers.

Equal sets are one class from the start, and only classes are joined. Sets of sizes a and b
reach the threshold when they share o(a, b) shingles, so

- light: for every size b that a set of size a can link with, both enumerate their subsets of
  o(a, b) shingles; two sets that share such a subset are linked, without further checks. All
  sets that share one are linked with the first of the other side, so links stay linear in the
  size of a group;
- heavy: sets too large for that scan inverted lists. A list holds the sets that have a shingle
  among their first ones in a global order, rarest first; a linked pair meets in the list of
  its first common shingle, at places that leave room for the overlap. Pairs are further cut
  by a bitmap of the parity of ``BITS`` counters, of ``WIDE_BITS`` for large sets, which never cuts
  a linked pair, and what is left is checked on the whole sets.

The boundary size is where the estimated rows of both ways add up to the least. The order and
the estimate come from a sketch of the number of classes per shingle, of fixed size, which
counts all of them; errors of the sketch make lists longer, never a link lost.

A list may hold a third of all sets. Where its size is above ``CELL``, it is cut into cells that
are searched apart: a first round finds, within each cell, a forest of candidate links; checked,
they merge most of a family, and the lists whose sets are in one component by then are done, as
are sets without a candidate. A second round searches the rest whole, pairs of cells by pairs, but
only for pairs between different components. Neither emits all pairs of a group.

Rows are saved with their places and texts are fetched again by place, with a bit per row
(``places.py``): a text never shuffles, at any size.

A text with fewer words than a shingle has is one shorter shingle, one without words is empty
and linked with nothing. NULL counts as empty. A NULL id never names a component unless all
ids in it are NULL; rows that share an id are texts of their own. An empty table gives an
empty result.
"""

from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices, texts_of
from tidemark.llm.components import components
from tidemark.llm.places import BROADCAST_BYTES, meet, save_placed
from tidemark.llm.shingles import mix, set_digest, shingle_set
from tidemark.sources.tables import materialise, scratch

WIDTH = 3
#: Two sets are linked when 100 * intersection >= PERCENT * union.
PERCENT = 90
BITS = 1024
#: Bits of a second bitmap for candidates of more than ``BITS`` shingles, which fill the first.
WIDE_BITS = 8192
#: Counters of the sketch, as powers of two, and those of one of its rows.
SKETCH_BITS, CHUNK_BITS = 18, 12
#: The boundary is looked for up to this size of a set.
LARGEST_LIGHT = 40
#: Sets of a cell of an inverted list, and rows of a list that one task reads at first.
CELL, LIST_ROWS = 2048, 1 << 16
#: Classes up to this number go along with the tasks that read whole sets again.
BROADCAST_IDS = 1_000_000

PRINTS = "doc_id bigint, place bigint, n bigint, cls bigint, bits binary, chunk int, part int"
KEYS = "key bigint, salt int, hot boolean, cls bigint, n int, place int"
LISTED = "key bigint, cls bigint, n int, place int"
SETS = "cls bigint, n bigint, wide binary, shingles binary"
PAIRS = "u bigint, v bigint"


class Rule:
    """Sizes and overlaps that linked sets have."""

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, n):
        """The smallest size that a set of size ``n`` can link with."""
        return -(-self.percent * n // 100)

    def largest(self, n):
        return 100 * n // self.percent

    def overlap(self, total):
        """What sets of ``total`` shingles together must share."""
        return -(-self.percent * total // (100 + self.percent))

    def prefix(self, n):
        return n - self.least(n) + 1

    def light_keys(self, n: int, boundary: int) -> list[tuple[int, int, int]]:
        """(smaller size, larger size, shingles to leave out) of the subsets a light set lists."""
        found = []
        for other in range(self.least(n), min(self.largest(n), boundary) + 1):
            small, large = min(n, other), max(n, other)
            overlap = self.overlap(n + other)
            # Equal sets are one class; sets of one size that must share all are equal.
            if overlap <= small and not small == large == overlap:
                found.append((small, large, n - overlap))
        return found

    def may_link(self, n1, at1, n2, at2):
        """Whether a common shingle at these places can be the first of a linked pair."""
        left = np.minimum(n1 - at1, n2 - at2)
        return (100 * np.minimum(n1, n2) >= self.percent * np.maximum(n1, n2)) & (left >= self.overlap(n1 + n2))


@cache
def _left_out(n: int, r: int) -> np.ndarray:
    return np.array(list(combinations(range(n), r)), "i4").reshape(comb(n, r), r)


def light_rows(hashes: np.ndarray, keys: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(key, side) of the subsets of a light set; side 1 is the larger size of the two."""
    mixed, n, rows = mix(hashes), len(hashes), []
    total = mixed.sum(dtype="u8")
    for small, large, r in keys:
        gone = mixed[_left_out(n, r)].sum(axis=1, dtype="u8")
        tag = mix(np.array([small << 20 | large], "u8"))
        side = int(n == large and small != large)
        rows += [(k, side) for k in mix((total - gone) ^ tag).view("i8").tolist()]
    return rows


def _parity(hashes: np.ndarray, bits: int) -> bytes:
    counts = np.bincount((hashes >> np.uint64(64 - bits.bit_length() + 1)).astype("i8"), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def _prints(placed: DataFrame, width: int) -> DataFrame:
    """Per row of ``placed`` (doc_id, text, place) its id, place, size of set, class and bitmap; and
    the tasks' sketches, as rows with a ``chunk``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, part = np.zeros(1 << SKETCH_BITS, "u4"), set(), TaskContext.get().partitionId()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
        schema = pa.schema(list(zip([c.split()[0] for c in PRINTS.split(", ")], kinds)))
        for batch in batches:
            for piece in slices(batch, "text"):
                n, cls, bits = [], [], []
                for text in texts_of(piece.column("text")):
                    hashes = shingle_set(text, width)
                    n.append(len(hashes))
                    cls.append(set_digest(hashes))
                    bits.append(_parity(hashes, BITS))
                    if cls[-1] not in seen:
                        seen.add(cls[-1])
                        slots = (hashes >> np.uint64(64 - SKETCH_BITS)).astype("i8")
                        if len(slots) < len(sketch) // 8:
                            np.add.at(sketch, slots, np.uint32(1))
                        else:
                            sketch += np.bincount(slots, minlength=len(sketch)).astype("u4")
                size = len(n)
                columns = [piece.column("doc_id"), piece.column("place"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())]
                nulls = pa.nulls(size, pa.int32())
                yield pa.RecordBatch.from_arrays([*columns, nulls, nulls], schema=schema)
        if seen:
            chunks = sketch.reshape(-1, 1 << CHUNK_BITS).astype("<u4")
            size = len(chunks)
            rows = [pa.nulls(size, kind) for kind in kinds[:4]]
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array([c.tobytes() for c in chunks], pa.binary()), pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int32())],
                schema=schema,
            )

    return materialise(map_arrow(placed.select("doc_id", "place", "text"), read, PRINTS), keep=True)


def _sketch(prints: DataFrame) -> np.ndarray:
    """The tasks' sketches summed up, first by groups of 64 tasks: 1 MB at any size of input."""

    def add(rows: pa.Table) -> pa.Table:
        counts = reduce(np.add, (np.frombuffer(b, "<u8" if len(b) == 8 << CHUNK_BITS else "<u4").astype("u8") for b in rows.column("bits").to_pylist()))
        return pa.table({"chunk": rows.column("chunk")[:1], "bits": pa.array([counts.tobytes()], pa.binary())})

    rows = prints.filter(F.col("chunk").isNotNull()).select("chunk", "bits", F.floor(F.col("part") / 64).alias("of"))
    some = rows.groupBy("chunk", "of").applyInArrow(add, "chunk int, bits binary")
    whole = some.groupBy("chunk").applyInArrow(add, "chunk int, bits binary")
    sketch = np.zeros(1 << SKETCH_BITS, "u8")
    for row in whole.collect():
        sketch[row.chunk << CHUNK_BITS : (row.chunk + 1) << CHUNK_BITS] = np.frombuffer(row.bits, "<u8")
    return sketch


def best_boundary(sizes: dict[int, int], sketch: np.ndarray, rule: Rule) -> int:
    """The size up to which sets are light. A subset costs a row; a place in a list costs a row
    and a visit to the list's other sets, as many as the sketch expects."""
    total = float(sketch.sum())
    # Of the sets that share a shingle's counter, those that chance alone puts there don't count,
    # nor does the set itself.
    shared = float((sketch.astype("f8") ** 2).sum()) / total if total else 0.0
    visits = max(0.0, shared - total / len(sketch) - 1)

    def cost(boundary: int) -> float:
        rows = 0.0
        for n, count in sizes.items():
            if n <= boundary:
                rows += count * sum(comb(n, r) for _, _, r in rule.light_keys(n, boundary))
            if rule.largest(n) > boundary:
                rows += count * rule.prefix(n) * (1 + visits)
        return rows

    return min(range(1, LARGEST_LIGHT + 1), key=cost)


def _keys(placed: DataFrame, width: int, rule: Rule, boundary: int, sketch: np.ndarray) -> DataFrame:
    """The light subsets (place -1 or -2, by side) and the places in inverted lists, saved. Equal
    sets are listed once per task."""
    order = sketch.astype("u8")
    floor = 4 * int(sketch.mean())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                parts = []
                for text in texts_of(piece.column("text")):
                    hashes = shingle_set(text, width)
                    n, cls = len(hashes), set_digest(hashes)
                    if not n or cls in seen:
                        continue
                    seen.add(cls)
                    if n <= boundary and (rows := light_rows(hashes, rule.light_keys(n, boundary))):
                        key, side = np.array(rows, "i8").T
                        parts.append((key, np.zeros(len(key), "i4"), cls, n, -1 - side.astype("i4")))
                    if rule.largest(n) > boundary:
                        slots = (hashes >> np.uint64(64 - SKETCH_BITS)).astype("i8")
                        first = np.lexsort((hashes, order[slots]))[: rule.prefix(n)]
                        above = order[slots[first]].astype("i8") - floor
                        salts = np.maximum(1, -(-above // LIST_ROWS))
                        salt = np.where(salts > 1, 1 + cls % salts, 0).astype("i4")
                        parts.append((hashes[first].view("i8"), salt, cls, n, np.arange(len(first), dtype="i4")))
                if parts:
                    length = [len(p[0]) for p in parts]
                    salt = np.concatenate([p[1] for p in parts])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([p[0] for p in parts])),
                            pa.array(salt),
                            pa.array(salt > 0),
                            pa.array(np.repeat(np.array([p[2] for p in parts], "i8"), length)),
                            pa.array(np.repeat(np.array([p[3] for p in parts], "i4"), length)),
                            pa.array(np.concatenate([p[4] for p in parts])),
                        ],
                        names=[c.split()[0] for c in KEYS.split(", ")],
                    )

    return materialise(map_arrow(placed.select("text"), read, KEYS))


def _light_links(keys: DataFrame) -> DataFrame:
    """Links from every set of a subset to the first set of the other side (of the same side
    where sizes are equal: there, all have side 0 and the key occurs for one size only)."""
    rows = keys.filter("place < 0").select("key", "cls", "n", "place")
    least = F.min(F.when(F.col("place") == -1, F.col("cls"))).alias("small")
    most = F.min(F.when(F.col("place") == -2, F.col("cls"))).alias("large")
    heads = rows.groupBy("key").agg(least, most, F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a <> b")
    met = rows.join(materialise(heads.select("key", "small", "large")), "key")
    # Without a large side the sizes are equal and all sets of the key are linked with the first.
    equal = F.col("large").isNull()
    other = F.when((F.col("place") == -2) | equal, F.col("small")).otherwise(F.col("large"))
    links = met.select(F.least("cls", other).alias("u"), F.greatest("cls", other).alias("v"))
    return materialise(links.filter("u < v").distinct())


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, and where each run starts (the end as well)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        columns = [np.asarray(batch.column(c)) for c in by]
        first = [c.slice(0, 1).to_pylist() for c in (held[0].column(name) for name in by)]
        if all(c[0] == c[-1] for c in columns) and first == [[c[0].item()] for c in columns]:
            continue  # one run so far
        whole = pa.Table.from_batches(held)
        starts = _starts(whole, by)
        yield whole.slice(0, int(starts[-2])), starts[:-1]
        held = whole.slice(int(starts[-2])).to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, _starts(whole, by)


def _starts(table: pa.Table, by: list[str]) -> np.ndarray:
    changes = np.zeros(table.num_rows - 1, bool)
    for name in by:
        column = table.column(name).to_numpy()
        changes |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(changes) + 1, [table.num_rows]])


def _inverted_lists(keys: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """The rows of lists that can hold a linked pair, saved: those with a partner of fitting size
    and place, of which one is heavy. Most shingles are in one set only and end here."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(batches, ["key", "salt"]):
            key, cls = table.column("key").to_numpy(), table.column("cls").to_numpy()
            n, place = table.column("n").to_numpy().astype("i8"), table.column("place").to_numpy().astype("i8")
            # Parts of a list that was cut because it is long always hold several sets.
            use = table.column("hot").to_numpy(zero_copy_only=False).copy()
            size = np.diff(starts)

            def fits(a, b):
                return rule.may_link(n[a], place[a], n[b], place[b]) & (cls[a] != cls[b]) & (np.maximum(n[a], n[b]) > boundary)

            two = starts[:-1][size == 2]
            both = fits(two, two + 1)
            use[two] |= both
            use[two + 1] |= both
            for i in np.flatnonzero(size > 2):
                a, b = int(starts[i]), int(starts[i + 1])
                if use[a]:
                    continue
                _, once = np.unique(cls[a:b], return_index=True)
                at = a + once
                if len(at) > CELL:
                    use[at] = True
                else:
                    use[at] = fits(at[:, None], at[None, :]).any(axis=1)
            if use.any():
                yield from table.filter(pa.array(use)).select([c.split()[0] for c in LISTED.split(", ")]).to_batches()

    rows = keys.filter("place >= 0").repartition("key", "salt").sortWithinPartitions("key", "salt")
    return materialise(map_arrow(rows, keep, LISTED))


def _candidates(cells: DataFrame, rule: Rule, boundary: int, forest: bool) -> DataFrame:
    """Pairs of sets of different components (``comp``) that may be linked: of each cell a
    forest that spans them, or all. In a cell of two parts, pairs of one part are left to its
    own cell."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _runs(batches, ["key", "low", "high"]):
            cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
            n, place = table.column("n").to_numpy().astype("i8"), table.column("place").to_numpy().astype("i8")
            own, mixed = table.column("own").to_numpy(), table.column("low").to_numpy() != table.column("high").to_numpy()
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, BITS // 64)

            def linked(a: int, b: np.ndarray) -> np.ndarray:
                fit = rule.may_link(n[a], place[a], n[b], place[b]) & (comp[a] != comp[b]) & (cls[a] != cls[b])
                fit &= np.maximum(n[a], n[b]) > boundary
                if mixed[a]:
                    fit &= own[b] != own[a]
                b = b[fit]
                apart = np.bitwise_count(bits[b] ^ bits[a]).sum(axis=1, dtype="i8")
                total = n[b] + n[a]
                return b[apart <= total - 2 * rule.overlap(total)]

            found = []
            for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                rest = np.arange(begin, end)
                if end - begin < 2 or (comp[begin:end] == comp[begin]).all():
                    continue
                if not forest:
                    for a in range(begin, end - 1):
                        found += [(a, b) for b in linked(a, np.arange(a + 1, end)).tolist()]
                    continue
                queue: list[int] = []
                while len(rest) or queue:
                    if not queue:
                        queue, rest = [int(rest[0])], rest[1:]
                    a = queue.pop()
                    near = linked(a, rest)
                    found += [(a, b) for b in near.tolist()]
                    queue += near.tolist()
                    rest = np.setdiff1d(rest, near, assume_unique=True)
            if found:
                a, b = cls[np.array(found)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["u", "v"])

    ordered = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return map_arrow(ordered, search, PAIRS).distinct()


def _sets(placed: DataFrame, wanted: DataFrame, width: int, limit: int) -> DataFrame:
    """The whole sets of the texts at the places ``wanted``, one of each class, saved."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                rows = []
                for text in texts_of(piece.column("text")):
                    hashes = shingle_set(text, width)
                    wide = _parity(hashes, WIDE_BITS) if len(hashes) > BITS else b""
                    rows.append((set_digest(hashes), len(hashes), wide, hashes.astype("<u8").tobytes()))
                columns = zip(*rows) if rows else ((), (), (), ())
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["cls", "n", "wide", "shingles"]
                )

    return materialise(meet(placed, wanted, lambda met: map_arrow(met.filter("hit").select("text"), read, SETS), limit))


def _checked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose whole sets reach the threshold, saved. Pairs of large sets meet by their
    second bitmaps first, so that few large sets have to meet."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b, n in zip(*(batch.column(c).to_pylist() for c in ("wide_u", "wide_v", "n"))):
                apart = np.bitwise_count(np.frombuffer(a, "u1") ^ np.frombuffer(b, "u1")).sum(dtype="i8") if a and b else 0
                good.append(bool(apart <= n - 2 * rule.overlap(n)))
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("shingles_u").to_pylist(), batch.column("shingles_v").to_pylist()):
                a, b = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                common = len(a) + len(b) - len(np.union1d(a, b))
                good.append(100 * common >= rule.percent * (len(a) + len(b) - common))
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    met = pairs.join(side("u", "n", "wide"), "u").join(side("v", "n", "wide"), "v")
    close = materialise(map_arrow(met.select("u", "v", (F.col("n_u") + F.col("n_v")).alias("n"), "wide_u", "wide_v"), prune, PAIRS).distinct())
    needed = materialise(_ends(close))
    if needed.count() <= BROADCAST_IDS:
        sets = sets.join(F.broadcast(needed), "cls", "left_semi")
    met = close.join(side("u", "shingles"), "u").join(side("v", "shingles"), "v")
    return materialise(map_arrow(met.select("u", "v", "shingles_u", "shingles_v"), check, PAIRS).distinct())


def near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links lead to, its own included).
    ``limit`` bounds, in bytes, the bits that are broadcast at a time to fetch texts."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    with scratch(docs.sparkSession):
        picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
        placed = materialise(picked.withColumn("place", F.monotonically_increasing_id()))
        found = _found(placed, width, percent, limit)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _found(placed: DataFrame, width: int, percent: int, limit: int) -> DataFrame:
    """Per row of ``placed`` (doc_id, text, place) its id, place, size of set and, unless it is empty,
    its component's label and id. Texts are fetched by place, so none shuffles."""
    rule = Rule(percent)
    prints = _prints(placed, width)
    rows = prints.filter(F.col("chunk").isNull())
    with scratch(placed.sparkSession):
        of_class = materialise(_components(placed, prints, rows, rule, width, limit), keep=True)
    return rows.select("doc_id", "place", "n", "cls").join(of_class, "cls", "left")


def _components(placed, prints, rows, rule, width, limit) -> DataFrame:
    """The component (label and smallest id) of every class that is not empty."""
    sketch = _sketch(prints)
    classes = rows.filter("n > 0").groupBy("cls", "n").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"))
    classes = materialise(classes)
    counted = classes.filter(F.col("n") <= rule.largest(LARGEST_LIGHT)).groupBy("n").count().collect()
    boundary = best_boundary({r["n"]: r["count"] for r in counted}, sketch, rule)

    keys = _keys(placed, width, rule, boundary, sketch)
    links = _light_links(keys)
    lists = _inverted_lists(keys, rule, boundary)

    def sets_of(pairs: DataFrame) -> DataFrame:
        return _sets(placed, classes.join(_ends(pairs), "cls", "left_semi"), width, limit)

    links = links.unionByName(_heavy_links(lists, rows, rule, boundary, links, sets_of))
    labels = components(links)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = materialise(named)
    smallest = materialise(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    return named.join(smallest, "label").select("cls", "label", "component_id")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()


def _heavy_links(
    lists: DataFrame,
    rows: DataFrame,
    rule: Rule,
    boundary: int,
    links: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """The checked links from the inverted lists that components need. Whole sets are only made,
    by ``sets_of``, for candidates that the bitmaps left."""
    sizes = lists.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > CELL)
    parts = F.coalesce(F.ceil(F.col("size") / CELL), F.lit(1)).cast("int")
    listed = lists.join(materialise(sizes), "key", "left").select("*", parts.alias("parts")).drop("size")
    listed = listed.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    wanted = materialise(lists.select("cls").distinct())
    some = rows.filter("n > 0").select("cls", "bits").join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    bitmaps = materialise(some)

    single = listed.withColumn("comp", F.col("cls")).withColumn("low", F.col("own")).withColumn("high", F.col("own"))
    first = materialise(_candidates(single.join(bitmaps, "cls"), rule, boundary, forest=True))
    sure = _checked(first, sets_of(first), rule)

    # A set without any candidate in a list that was searched whole has none in the second round.
    labels = components(links.unionByName(sure)).withColumnRenamed("node", "cls").withColumnRenamed("label", "comp")
    found = materialise(_ends(first))
    whole = listed.filter("parts = 1").join(found, "cls", "left_semi")
    again = whole.unionByName(listed.filter("parts > 1"))
    merged = materialise(again.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    several = merged.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b")
    open_ = merged.join(materialise(several.select("key")), "key", "left_semi")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = open_.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    second = _candidates(cells.join(bitmaps, "cls"), rule, boundary, forest=False)
    left = materialise(second.join(first, ["u", "v"], "left_anti"))
    return sure.unionByName(_checked(left, sets_of(left), rule))


def drop_near_duplicates(
    docs: DataFrame,
    width: int = WIDTH,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that stay: all empty ones, and of every component exactly one, with the
    smallest id (a NULL id comes last; of rows that share the id, the first by place). ``limit``
    bounds, in bytes, the bits that are broadcast at a time."""
    saved = save_placed(docs)
    with scratch(docs.sparkSession):
        placed = saved.select(
            F.col(f"doc.`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"doc.`{text_column}`").alias("text"), "place"
        )
        gone = _gone(_found(placed, width, percent, limit))
        return meet(saved, gone, lambda met: met.filter("not hit").select("doc.*"), limit, keep=True)


def _gone(found: DataFrame) -> DataFrame:
    """The places of all rows of a component but the one that stays."""
    rows = materialise(found.filter(F.col("label").isNotNull()).select("label", "doc_id", "place"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place"))
    several = rows.groupBy("label").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Saved, so that its join is planned on its true size and a hot component can be split.
    several = materialise(several.select("label", F.col("first.place").alias("stays")))
    return rows.join(several, "label").filter("place <> stays").select("place")
