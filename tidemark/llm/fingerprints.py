"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is the multiset of its shingles of five words (a text of fewer words is one shingle),
each weighted with how often it occurs. Every sample of a fingerprint picks one weighted shingle
by Ioffe's scheme: with r and c drawn from Gamma(2, 1) and b from [0, 1) by the hash of shingle and
sample, t = floor(ln(weight) / r + b) and ln(a) = ln(c) - r * (t + 1 - b); the shingle with the least a is
picked. Two documents pick the same (shingle, t) with a probability equal to their generalised
Jaccard similarity, sum of lesser weights over sum of greater ones. ln(a) is a function of shingle, t
and sample, so it stands for what was picked, and a fingerprint is 16 bits of its hash per sample. The
likeness of two fingerprints is the share of samples that agree; its standard error is at most
0.5 / sqrt(samples).

The gamma draws come from two tables of 4,096 draws each, made of uniform hashes (one row, a scalar
subquery); the hash of shingle and sample picks from both by 12 bits each and gives b by 32. A sample
is a ``min`` of doubles per text, beside the shingles' generator in the same stage: shingles
never shuffle.

``compare`` also fingerprints each text with its last half replaced by the start of the next
document's, in descending order of ids (NULL last, then by digest; after the last comes the first). Only
digests, lengths and ids are ordered: range partitions are linked within, and at their ends by one row per
partition. Texts shuffle once by a digest of id and text, and what a neighbour needs of one, at
most half, once more. Rows that share id and text are one text with a count until the result is
written, so a hot row is one row per map task; its copies are each other's next documents.

NULL and empty texts have no shingle and one fingerprint of their own, with likeness 1 to each
other and 0 to others. Words are split at ASCII white space and case counts. Texts of any length
are read whole. A table of one document is its own next one; an empty table gives no rows. Columns
other than id and text are not read.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import materialise, scratch

WIDTH, SAMPLES = 5, 64
TABLE_BITS = 12
#: Copies that one task writes out of one row.
PIECE = 10_000
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _uniform(index: Column, stream: int) -> Column:
    """A number above 0 and up to 1."""
    return (F.pmod(F.xxhash64(index, F.lit(stream)), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))


def _gamma(index: Column, stream: int) -> Column:
    """A draw from Gamma(2, 1): the sum of two exponential ones."""
    return -F.log(_uniform(index, 2 * stream) * _uniform(index, 2 * stream + 1))


def _tables(spark: SparkSession) -> tuple[Column, Column]:
    """Draws of r and of ln(c), as scalar subqueries."""
    draws = spark.range(1 << TABLE_BITS, numPartitions=1).select(
        "id", _gamma(F.col("id"), 1).alias("r"), F.log(_gamma(F.col("id"), 2)).alias("c")
    )
    listed = draws.agg(F.sort_array(F.collect_list(F.struct("id", "r", "c"))).alias("d"))
    return tuple(listed.select(F.col(f"d.{c}")).scalar() for c in ("r", "c"))


def weighted_shingles(text: Column, width: int = WIDTH) -> Column:
    """Array of (``term``, ``n``): the hash of each distinct shingle and how often it occurs."""
    words = F.transform(F.filter(F.split(text, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(words: Column) -> Column:
        last = F.greatest(F.size(words) - width, F.lit(0))
        term = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)])
        none = F.array().cast("array<bigint>")
        return F.when(F.size(words) == 0, none).otherwise(F.transform(F.sequence(F.lit(0), last), term))

    def starts(sorted_: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(sorted_, i) != F.get(sorted_, i - 1))
        places = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), new)
        return _let(places, lambda at: F.transform(at, lambda s, j: run(sorted_, at, s, j)))

    def run(sorted_: Column, at: Column, s: Column, j: Column) -> Column:
        end = F.coalesce(F.get(at, j + 1), F.size(sorted_))
        return F.struct(F.get(sorted_, s).alias("term"), (end - s).alias("n"))

    def counted(found: Column) -> Column:
        once = F.transform(found, lambda x: F.struct(x.alias("term"), F.lit(1).alias("n")))
        repeats = F.size(F.array_distinct(found)) < F.size(found)
        return F.when(repeats, _let(F.sort_array(found), starts)).otherwise(once)

    return _let(_let(words, shingles), counted)


def _samples(samples: int) -> list[Column]:
    """ln(a) of a weighted shingle (``term``, ``log_n``) for each sample; NULL where ``log_n`` is."""
    mask = F.lit((1 << TABLE_BITS) - 1)
    out = []
    for i in range(samples):
        h = F.xxhash64("term", F.lit(i))
        r = F.get("r_table", h.bitwiseAND(mask).cast("int"))
        c = F.get("c_table", F.shiftright(h, TABLE_BITS).bitwiseAND(mask).cast("int"))
        b = F.shiftrightunsigned(h, 32) / F.lit(float(1 << 32))
        t = F.floor(F.col("log_n") / r + b)
        out.append(c - r * (t + 1 - b))
    return out


def _code(picked: Column) -> Column:
    """16 bits of what a sample picked, as four hexadecimal digits."""
    return F.lpad(F.hex(F.xxhash64(picked).bitwiseAND(F.lit(0xFFFF))), 4, "0")


def fingerprints(texts: DataFrame, samples: int = SAMPLES, width: int = WIDTH) -> DataFrame:
    """``texts`` (a column ``text``, and others that tell rows apart) with ``print``, the binary
    fingerprint, in place of the text. Where ``texts`` is dealt out by some of the others, no row
    moves."""
    keys = [c for c in texts.columns if c != "text"]
    # An outer explode keeps texts without a shingle, and the optimiser from testing the array first.
    terms = texts.select(*keys, F.explode_outer(weighted_shingles(F.col("text"), width)).alias("s"))
    r_table, c_table = _tables(texts.sparkSession)
    drawn = terms.select(
        *keys, F.col("s.term").alias("term"), F.log("s.n").alias("log_n"), r_table.alias("r_table"), c_table.alias("c_table")
    )
    least = drawn.groupBy(*keys).agg(*[F.min(a).alias(f"_{i}") for i, a in enumerate(_samples(samples))])
    return least.select(*keys, F.unhex(F.concat(*[_code(F.col(f"_{i}")) for i in range(samples)])).alias("print"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples on which two binary fingerprints agree."""
    same = [F.when(F.substring(a, 2 * i + 1, 2) == F.substring(b, 2 * i + 1, 2), 1).otherwise(0) for i in range(samples)]
    return reduce(Column.__add__, same).cast("double") / F.lit(float(samples))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Id, text and a key per row; rows with the same id and text share the key."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    named = F.coalesce(F.concat(F.lit("i"), F.col(id_column).cast("string")), F.lit("n"))
    key = F.unhex(F.sha2(F.concat(named, F.lit(":"), text).cast("binary"), 256))
    return docs.select(F.col(id_column).alias("id"), text.alias("text"), key.alias("key"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Per key: its id, number of ``copies`` and ``n_chars``, and ``user``, the key whose next one in
    descending order of ids it is, with ``user_half``, half the characters of that."""
    slim = rows.groupBy("key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.min(F.char_length("text")).cast("bigint").alias("n_chars")
    )
    order = ("present", "id", "key")
    slim = slim.withColumn("present", F.col("id").isNotNull())
    ranged = slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged)
    within = Window.partitionBy("range").orderBy(*order)
    place = F.struct(*order, "n_chars")
    ends = ranged.groupBy("range").agg(F.min(place).alias("least"))
    # One row per range partition.
    along = Window.orderBy("range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range",
        F.coalesce(F.lead("least").over(along), F.first("least").over(whole)).alias("above"),
    )
    linked = ranged.select(
        "range", "key", "id", "copies", "n_chars", F.lead(place).over(within).alias("upper")
    )
    # The order is ascending: in descending order this key comes next after the one above.
    user = F.coalesce("upper", "above")
    return linked.join(ends, "range").select(
        "key",
        "id",
        "copies",
        "n_chars",
        user["key"].alias("user"),
        F.floor(user["n_chars"] / 2).cast("int").alias("user_half"),
    )


def compare(
    docs: DataFrame,
    samples: int = SAMPLES,
    width: int = WIDTH,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint in
    hexadecimal digits, near_edited and near_next."""
    rows = _rows(docs, id_column, text_column)
    with scratch(docs.sparkSession):
        links = materialise(neighbours(rows))
        firsts = Window.partitionBy("key").orderBy("key")
        texts = rows.select("key", "text").withColumn("n", F.row_number().over(firsts)).filter("n = 1").drop("n")
        owned = texts.join(links, "key")
        heads = owned.select(F.col("user").alias("key"), F.expr("left(text, user_half)").alias("head"))
        known = ["key", "id", "copies", "n_chars", "user"]
        both = owned.select(*known, "text").join(heads, "key")
        half = F.floor(F.char_length("text") / 2).cast("int")
        stays = F.substring(F.col("text"), F.lit(1), F.char_length("text") - half)
        edited, doubled = F.concat(stays, "head"), F.concat(stays, F.substring(F.col("text"), F.lit(1), half))

        def version(kind: int, text: Column) -> Column:
            sha = F.when(F.lit(kind > 0), F.unhex(F.sha2(text.cast("binary"), 256)))
            return F.struct(F.lit(kind).alias("kind"), sha.alias("sha"), text.alias("text"))

        own = F.array(version(0, F.col("text")), version(1, edited))
        versions = F.when(F.col("copies") > 1, F.array_append(own, version(2, doubled))).otherwise(own)
        spread = both.select(*known, F.explode(versions).alias("v")).select(*known, "v.kind", "v.sha", "v.text")
        made = fingerprints(spread, samples, width)
        picked = [
            F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name)
            for kind, c, name in ((0, "print", "own"), (1, "sha", "sha"), (1, "print", "edited"), (2, "sha", "sha2"), (2, "print", "doubled"))
        ]
        prints = materialise(made.groupBy(*known).agg(*picked), keep=True)
    after = prints.select(F.col("user").alias("key"), F.col("own").alias("after"))

    def result(sha: str, print_: str, after: Column) -> list[Column]:
        return [
            F.col("id").alias("doc_id"),
            "n_chars",
            F.lower(F.hex(sha)).alias("edited_sha256"),
            F.lower(F.hex("own")).alias("fingerprint"),
            F.lower(F.hex(print_)).alias("edited_fingerprint"),
            likeness(F.col("own"), F.col(print_), samples).alias("near_edited"),
            likeness(F.col("own"), after, samples).alias("near_next"),
        ]

    once = prints.join(after, "key").select(*result("sha", "edited", F.col("after")))
    # All copies but one have a copy as the next document; a hot row's are dealt out in pieces.
    again = prints.filter("copies > 1").withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 2) div {PIECE})")))
    again = again.withColumn("left", F.least(F.lit(PIECE), F.col("copies") - 1 - F.col("piece") * PIECE).cast("int"))
    again = again.repartition("own", "piece").withColumn("copy", F.explode(F.expr("sequence(1, left)")))
    return once.unionByName(again.select(*result("sha2", "doubled", F.col("own"))))
