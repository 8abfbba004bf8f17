"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source that should hold a share ``w`` of ``total`` rows and has ``n`` repeats each of its
rows ``w * total / n`` times on average. Each row draws its number of copies from a Poisson
distribution with that mean, by inverting it at a uniform number hashed from seed and a digest of the
row's ``identity`` (id and text): the draw needs no state, repeats after a lost executor and is the
same on any cluster. Rows are exploded by their count and dealt out by a hash of seed, digest and
copy, which shuffles the mixture globally.

Poisson means add up, so a mean above ``PIECE`` is drawn as the sum of equal pieces, each
with a uniform number of its own; the terms beyond ``TERMS`` of a piece have a probability
below the resolution of a double. Where a source repeats its rows more than ``CHUNK`` times, chunks of
copies shuffle before they are written out, so that not one task makes all copies of a row.

A NULL source is a source of its own. NULLs of the identity count as the text ``null``; rows that share
an id, or have none, draw for themselves by their texts, and rows with id and text alike are one
document given twice and share a draw. A row of any length is hashed whole. Columns come along
whatever their names, as the struct ``row``. An empty table gives an empty one.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_struct
from tidemark.sources.tables import materialise

PIECE = 16
TERMS = 100
CHUNK = 1000
SEED = 20240
#: Of the default weights: each source's number of rows to this power, as a share of the sum.
EXPONENT = 0.5


def source_rates(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: int | None = None,
    source_column: str = "source",
    exponent: float = EXPONENT,
) -> DataFrame:
    """Per source: rows ``n``, mean copies ``rate``, and ``pieces`` with the distribution
    function ``cdf`` of one piece. A source that ``weights`` leaves out gets no copies."""
    sizes = docs.groupBy(F.col(source_column).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    elif weights:
        listed = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        found = F.when(F.col("source").isNotNull(), F.element_at(listed, F.col("source")))
        weight = F.coalesce(found.cast("double"), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    sizes = sizes.withColumn("weight", weight)
    sums = sizes.agg(F.sum("weight").alias("w"), F.sum("n").alias("n"))
    all_rows = F.lit(total) if total is not None else sums.select("n").scalar()
    rate = F.try_divide(F.col("weight"), sums.select("w").scalar()) * all_rows / F.col("n")
    rates = sizes.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int")
    return rates.withColumn("pieces", pieces).withColumn("mean", F.col("rate") / F.col("pieces")).select(
        "source", "n", "rate", "pieces", _cdf(F.col("mean")).alias("cdf")
    )


def _cdf(mean: Column) -> Column:
    """The distribution function at 0, 1, ... ``TERMS``."""
    none = F.exp(-mean)
    start = F.struct(F.array(none).alias("cdf"), none.alias("p"))

    def add(so_far: Column, k: Column) -> Column:
        p = so_far["p"] * mean / k
        return F.struct(
            F.array_append(so_far["cdf"], F.element_at(so_far["cdf"], -1) + p).alias("cdf"), p.alias("p")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda done: done["cdf"])


def _uniform(seed: int, key: Column, piece: Column) -> Column:
    """52 bits of a digest as a number from 0 to below 1."""
    text = F.concat_ws(":", F.lit(str(seed)), key, piece.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    total: int | None = None,
    seed: int = SEED,
    identity: Sequence[str] = ("doc_id", "text"),
    source_column: str = "source",
    exponent: float = EXPONENT,
) -> DataFrame:
    """Struct ``row`` with the columns of ``docs``, ``copy`` from 1 and ``copies`` of its row,
    in shuffled order."""
    # Saved, so that its join is planned on its true size; a hot source can then be split.
    rates = materialise(source_rates(docs, weights, total, source_column, exponent))
    named = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in identity]
    keyed = docs.select(
        row_struct(docs), F.md5(F.concat_ws("\x1f", *named).cast("binary")).alias("digest"), F.col(source_column).alias("from")
    )

    def draw(i: Column) -> Column:
        """A piece's copies; its uniform number is bound to a name, so that it is computed once."""
        uniform = F.array(_uniform(seed, F.col("digest"), i))
        return F.transform(uniform, lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))[0]

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("pieces")), F.lit(0), lambda sum_, i: sum_ + draw(i))
    met = keyed.join(rates.select("source", "pieces", "cdf"), F.col("from").eqNullSafe(F.col("source")))
    counted = met.select("row", "digest", drawn.alias("copies")).filter("copies > 0")
    chunks = counted.select("*", F.explode(F.expr(f"sequence(0, (copies - 1) div {CHUNK})")).alias("chunk"))
    if rates.filter(F.col("rate") > CHUNK).limit(1).count():
        chunks = chunks.repartition("digest", "chunk")
    each = F.expr(f"sequence(int(chunk * {CHUNK} + 1), int(least(copies, (chunk + 1) * {CHUNK})))")
    copies = chunks.select("row", "digest", "copies", F.explode(each).alias("copy"))
    place = F.xxhash64(F.lit(seed), "digest", "copy")
    dealt = copies.withColumn("place", place).repartition("place").sortWithinPartitions("place")
    return dealt.select("row", "copy", "copies")
