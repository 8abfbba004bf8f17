"""The registered queries of the pipeline operators; each takes (spark, sf_dir)."""

from pyspark.sql import functions as F

from tidemark.llm import (
    exact_dedup,
    filter_audit,
    fingerprints,
    jaccard_join,
    language,
    mixing,
    packing,
    secrets,
    token_files,
    topk,
    toxicity,
    vector_codes,
    warc,
)
from tidemark.llm.common import table
from tidemark.llm.encoding import public_path
from tidemark.sources.tables import shared_dir


def op1_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    learned = toxicity.learned_fold()
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), learned)
    return toxicity.score(documents, model).select(
        "row.doc_id",
        (~toxicity.learned_fold("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_token_files(spark, sf_dir):
    root = shared_dir(spark)
    documents = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(documents, root, public_path("byte_bpe_50k.json"), end_id=2)
    read = token_files.read_token_files(manifest, root)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    profiles = language.learn_profiles(documents, language.learned_fold())
    found = language.predict(documents, profiles)
    return found.select("doc_id", (~language.learned_fold()).alias("held_out"), "lang_pred", "score")


def op5_packing(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    pieces = packing.pack(documents, public_path("word_bpe_49k.json"), end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_secrets(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = secrets.scan(documents, secrets.fit(documents))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans"
    )


def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_mixing(spark, sf_dir):
    """Every copy in the mixture, with the columns of documents."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("row.*", F.col("copy").cast("bigint"), F.col("copies").cast("bigint"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    root = shared_dir(spark)
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), root)
    read = warc.read_archives(manifest, root, payloads=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(books.sha256())
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op12_filter_audit(spark, sf_dir):
    masked = filter_audit.document_failures(table(spark, sf_dir, "documents"))
    return filter_audit.audit(filter_audit.weigh(masked, table(spark, sf_dir, "labels")))


def op13_fingerprints(spark, sf_dir):
    return fingerprints.compare(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk,
        op2_toxicity,
        op3_token_files,
        op4_language,
        op5_packing,
        op6_secrets,
        op7_jaccard_join,
        op8_mixing,
        op9_exact_dedup,
        op10_warc,
        op11_vector_codes,
        op12_filter_audit,
        op13_fingerprints,
    )
}
