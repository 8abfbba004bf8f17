"""Exact dedup by a two-pass Bloom filter, in DataFrame functions only.

Texts are equal when identical after every run of ASCII white space became one space; NULL
counts as empty. The first pass reduces each row to a digest and counts how many rows hit each
bit of a blocked Bloom filter; the bits hit twice form the filter of possibly repeated digests.
The second pass probes it: only digests that hit it are shuffled and grouped, all
others are unique for certain and pass straight through.

Texts never shuffle, at any size: what is grouped are digests with the place of their row. In
``exact_dedup`` the verdict comes back as one bit per row (``places.py``).

Of equal texts the row with the smallest ``doc_id`` stays (a NULL id comes last; of rows that
share id and text, one stays). Texts of any length are hashed whole. Every other column is carried
along unread, whatever its name. An empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.places import BLOCK_BITS, BROADCAST_BYTES, bit_set, meet, save_placed
from tidemark.sources.tables import materialise, scratch

BITS_PER_ROW = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def _slots(n_blocks: int) -> tuple[Column, Column]:
    """The block of a digest and its two bits there."""
    h = F.xxhash64("digest", F.lit(1))
    block = F.pmod(F.xxhash64("digest"), F.lit(n_blocks))
    bits = [F.pmod(F.shiftright(h, 20 * i), F.lit(BLOCK_BITS)).cast("int") for i in range(2)]
    return block, F.array(*bits)


def repeated_filter(digests: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """First pass: per block a bitmap of the bits that two or more rows hit, and the number
    of blocks. Counting combines in map tasks, so a hot digest is one row per task."""
    n_blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    block, bits = _slots(n_blocks)
    hit = digests.select(block.alias("block"), F.explode(F.array_distinct(bits)).alias("bit"))
    twice = hit.groupBy("block", "bit").agg(F.count("*").alias("n")).filter("n > 1")
    bitmaps = twice.groupBy("block").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    return materialise(bitmaps), n_blocks


def probe(rows: DataFrame, bitmaps: DataFrame, n_blocks: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Second pass: ``rows`` (with ``digest``) and whether the digest may be repeated."""
    block, bits = _slots(n_blocks)
    small = n_blocks * (BLOCK_BITS // 8) <= limit
    keyed = rows.select("*", block.alias("block"), bits.alias("bits"))
    met = keyed.join(F.broadcast(bitmaps) if small else bitmaps, "block", "left")
    both = bit_set(F.col("bits")[0]) & bit_set(F.col("bits")[1])
    return met.select(*rows.columns, F.coalesce(both, F.lit(False)).alias("maybe"))


def _judged(prints: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``prints`` (doc_id, digest, row) in two: the rows whose digest is no other's for certain, and
    the possibly repeated ones with ``n``, the size of their group, and ``first`` (doc_id, row), the
    one that stays; both NULL for a row that is alone after all."""
    probed = probe(prints, *repeated_filter(prints, prints.count()), limit)
    maybe = materialise(probed.filter("maybe").drop("maybe"), keep=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = maybe.groupBy("digest").agg(F.count("*").alias("n"), first.alias("first"))
    # Saved, so that its join is planned on its true size and a hot digest can be split.
    groups = materialise(groups.filter("n > 1"), keep=True)
    return probed.filter("not maybe").drop("maybe"), maybe.join(groups, "digest", "left")


def dedup_report(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (the id of the row that stays), group_size,
    kept, text_sha256 of the normalised text. A filter above ``limit`` bytes is joined."""
    prints = materialise(
        docs.select(
            F.col(id_column).alias("doc_id"),
            digest_of(F.col(text_column)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    alone, repeated = _judged(prints, limit)
    repeated = repeated.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    alone = alone.select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return alone.unionByName(repeated)


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = BROADCAST_BYTES
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. ``limit`` bounds, in bytes, the filter and
    the verdicts that are broadcast at a time."""
    placed = save_placed(docs)
    with scratch(docs.sparkSession):
        prints = materialise(
            placed.select(
                F.col(f"doc.`{id_column}`").alias("doc_id"), digest_of(F.col(f"doc.`{text_column}`")).alias("digest"), F.col("place").alias("row")
            )
        )
        repeated = _judged(prints, limit)[1].filter("first.row <> row")
        return meet(placed, repeated.select(F.col("row").alias("place")), _kept, limit, keep=True)


def _kept(met: DataFrame) -> DataFrame:
    return met.filter("not hit").select("doc.*")
