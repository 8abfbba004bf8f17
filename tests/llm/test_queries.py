"""The registered queries on the given tables, against their SQL or a brute-force version."""

import zlib
from collections import Counter

import numpy as np
import pytest
from documents_fixture import make_docs  # noqa: F401
from oracle_check import connect, difference
from test_exact_dedup import brute as equal_texts
from test_jaccard_join import brute as linked_texts
from test_mixing import expected as expected_copies

import __spark_entry__ as contract
import corpus_pipeline
from tidemark.llm import mixing, toxicity
from tidemark.llm.encoding import Encoder, public_path
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    return [(r.doc_id, r.text) for r in rows]


def run(spark, name):
    return contract.queries()[name](spark, SF_DIR)


def test_the_queries_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in contract.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in contract.queries()
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_its_sql(spark, name):
    got = run(spark, name).toPandas()
    assert difference(got, connect(SF_DIR).execute(ORACLES[name]).df()) is None


def ids_of(documents, file, end):
    coder = Encoder(public_path(file)).tokenizer
    return {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, end], "<u4") for i, t in documents}


def test_token_files(spark, documents):
    want, start = [], 0
    for i, ids in ids_of(documents, "byte_bpe_50k.json", 2).items():
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = run(spark, "op3_token_files")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def assert_packed(rows, ids):
    """Every id of every copy of a document in one piece, gapless sequences of 2,048."""
    at, copies, open_ = 0, Counter(), {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == at
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and open_.get(r.doc_id, 0) in (r.start, len(own)) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        copies[r.doc_id] += r.start == 0
        open_[r.doc_id] = r.start + r.length
        at += r.length
    assert all(end == len(ids[i]) for i, end in open_.items())
    return copies


def test_packing(spark, documents):
    ids = ids_of(documents, "word_bpe_49k.json", 1)
    assert assert_packed(run(spark, "op5_packing").collect(), ids) == Counter({i: 1 for i in ids})


def test_secrets(spark, documents):
    import hashlib

    from test_secrets import brute as matches

    names = ("assign", "access", "hex")
    want = {}
    for i, text in documents:
        spans = matches(text)
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        want[i] = (*[sum(k == kind for _, k, _ in spans) for kind in range(3)], hashlib.sha256(joined.encode()).hexdigest())
    got = run(spark, "op6_secrets").collect()
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == want and len(got) == len(want)


def test_jaccard_join(spark, documents):
    assert sorted(map(tuple, run(spark, "op7_jaccard_join").collect()), key=str) == linked_texts(documents)


def test_classifiers_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    found = contract.queries()["op4_language"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    toxic = contract.queries()["op2_toxicity"](spark, d).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.predicted == (r.score >= 0.3) and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in toxic)
    bad = [r.predicted for r in toxic if r.toxic]
    good = [r.predicted for r in toxic if not r.toxic]
    assert sum(bad) / len(bad) > 0.75 and sum(good) / len(good) < 0.05


def test_pipeline_against_its_stages_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    docs = {r.doc_id: r for r in rows}
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{SF_DIR}/labels.parquet"), toxicity.learned_fold())
    scores = model.scores([r.text or "" for r in rows])
    left = [(r.doc_id, r.text) for r, s in zip(rows, scores) if s < toxicity.THRESHOLD]
    kept = {i for i, _, _, keep, _ in equal_texts(left) if keep}
    left = [(i, t) for i, t in left if i in kept]
    kept = {c for _, _, c in linked_texts(left, width=corpus_pipeline.SHINGLE_WORDS, percent=corpus_pipeline.SIMILARITY_PERCENT)}
    left = [(i, docs[i].text, docs[i].lang, docs[i].source) for i, _ in left if i in kept]
    sizes = Counter(s for *_, s in left)
    total = sum(n**mixing.EXPONENT for n in sizes.values())
    rates = {s: n**mixing.EXPONENT / total * len(left) / n for s, n in sizes.items()}
    ids = ids_of([(i, t) for i, t, *_ in left], corpus_pipeline.TOKENIZER, corpus_pipeline.END_ID)
    assert assert_packed(run(spark, "pipeline").collect(), ids) == expected_copies(left, rates)


def test_stages_take_and_return_documents(spark, make_docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "jaccard_join", "mixing", "packing"]
    none = make_docs([(1, "x")], clashes=True).limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, none, SF_DIR)
        assert got.schema.names == none.schema.names and got.count() == 0
    odd = make_docs([(1, None, None, None), (2, "", "en", "s"), (None, "some text here", "en", "t"), (3, "x y " * 5, "en", "s")], clashes=True)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF_DIR).collect()
