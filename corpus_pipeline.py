"""A corpus pipeline: toxic documents go, then exact copies, then near copies; the rest is mixed
from its sources to target weights and packed into training sequences.

A stage is a function of (spark, docs, sf_dir). Its result is written as parquet and read again
as the next one's ``docs``, so that a lost executor costs one stage at most and every stage is
planned on the true size of its input. All stages but the last return the columns of documents.
Models and thresholds are those of the registered queries; near copies are judged here on
shingles of five words at a similarity of 0.8.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from tidemark.llm.common import table
from tidemark.llm.encoding import public_path
from tidemark.sources.tables import materialise

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
TOKENIZER, END_ID = "word_bpe_49k.json", 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model learned from the labels of those here."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.learned_fold())
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts the document with the smallest id."""
    return jaccard_join.drop_near_duplicates(docs, width=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, shuffled; a document may come several times."""
    return mixing.mix_sources(docs).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, in the order of the mixture."""
    pieces = packing.pack(docs, public_path(TOKENIZER), end_id=END_ID)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The toxicity model and the packing of tokens have no SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
