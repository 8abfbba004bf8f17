import zlib

import numpy as np
import pytest
from documents_fixture import make_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, token_files
from tidemark.llm.encoding import Encoder, public_path
from tidemark.sources.tables import shared_dir

BYTE, WORD = public_path("byte_bpe_50k.json"), public_path("word_bpe_49k.json")
ENCODERS = [Encoder(BYTE), Encoder(WORD)]

ODD = [
    "", " ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a\n b", "a \nb", "\na", "a\n", "a\tb c", "a\r\nb", "don't we'll I'M x's",
    "x <|endoftext|> y", "a<|endoftext|>b", "naïve café Übergröße ÀÉ ß", "É̩ a ́b", "ΑΣ ΣΑΣ b", "İstanbul I", "Kelvin K", "a b c",
    "\x1c a", "a\x1cb c", "a ퟿ b", "🙂 🙂🙂 a", "12 345 x9 9x 1.5", "a​b  c", "foo, bar. (baz) \"q\"! a--b", "hello world " * 50,
    "UPPER Case miXed", "a.b.c", "co-op re-do", "x" * 5000, "ñ ñandú", "ﬁ ligature", "日本語 テキスト", "a|b <b> [c] {d}", "'s 's", "it's' it",
]


@pytest.mark.parametrize("coder", ENCODERS, ids=["byte", "word"])
def test_ids_are_those_of_the_library(coder):
    for _ in range(2):
        for text in ODD:
            want = coder.tokenizer.encode(text, add_special_tokens=False).ids
            assert coder.encode(text).tolist() == want, text


PIECES = st.one_of(
    st.sampled_from([" ", "  ", "\n", " \n", "'s", "'", ".", ",", "-", "é", "É", "́", "ß", "word", "Word", "9", " ", "日"]),
    st.text(max_size=4),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25))
def test_ids_of_any_text(pieces):
    text = "".join(pieces)
    if any(0xD800 <= ord(c) <= 0xDFFF for c in text):
        return
    for coder in ENCODERS:
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("tidemark.llm.encoding.CACHE_WORDS", 3)
    coder = Encoder(BYTE)
    for text in ODD * 2:
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_the_cache_is_bounded_in_bytes_and_within_a_text(monkeypatch):
    monkeypatch.setattr("tidemark.llm.encoding.CACHE_WORDS", 100)
    for path in (BYTE, WORD):
        coder = Encoder(path)
        text = " ".join(f"{'long' * 30}.{chr(97 + i % 26)}w{chr(97 + i // 26)} {chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(600))
        assert coder.encode(text).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert 0 < len(coder.pieces) <= 100 and max(map(len, [*coder.pieces, *coder.runs])) <= 64


def test_a_hot_id_spreads_over_files(make_docs, spark):
    rows = [(None if i % 2 else i, f"text {i} of this table") for i in range(4000)]
    root = shared_dir(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins small files
    try:
        manifest = token_files.write_token_files(make_docs(rows), root, BYTE, end_id=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 4 and max(sizes) < 1.5 * 4000 / len(sizes)
    got = sorted(token_files.read_token_files(manifest, root).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2000 + list(range(0, 4000, 2))


TEXTS = [(i * 7 % 101, t) for i, t in enumerate(ODD)] + [(500, None), (None, "no id"), (7, "again 7"), (600, "long words here " * 20000)]


def encoded(path, end):
    coder = Encoder(path)
    return [(i, np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in TEXTS]


def by_id(pairs):
    return sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0))


def test_token_files_round_trip(make_docs, spark):
    root = shared_dir(spark)
    manifest = token_files.write_token_files(make_docs(TEXTS, clashes=True), root, BYTE, end_id=2)
    got = sorted(token_files.read_token_files(manifest, root).collect(), key=lambda r: r.start)
    want = by_id(encoded(BYTE, 2))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    start = 0
    for row in got:
        assert row.start == start and row.n_tokens == len(row.ids) // 4
        start += row.n_tokens
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), x.tobytes()) for i, x in want)


def test_files_are_flat_and_listed(make_docs, spark):
    root = shared_dir(spark)
    manifest = token_files.write_token_files(make_docs(TEXTS), root, BYTE, end_id=2).collect()
    total = 0
    for row in sorted(manifest, key=lambda r: r.part):
        ids = np.memmap(f"{root}/{row.file}.bin", "<u2", "r")
        assert len(ids) == row.n_tokens and row.base == total and ids[-1] == 2
        total += len(ids)
        head = np.fromfile(f"{root}/{row.file}.idx", "<u8", count=3)
        assert head.tobytes()[:8] == token_files.MAGIC and head[1:].tolist() == [row.n_docs, 2]


def test_an_end_id_must_fit(make_docs, spark):
    with pytest.raises(Exception, match="70000|out of bounds"):
        token_files.write_token_files(make_docs([(1, "x")]), shared_dir(spark), BYTE, end_id=70000)


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_cover_every_document(make_docs, length):
    got = packing.pack(make_docs(TEXTS, clashes=True), WORD, 1, length).collect()
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    at, documents, parts = 0, [], []
    for r in got:
        assert r.sequence_id * length + r.offset == at and 0 < r.length == len(r.ids) // 4 and r.offset + r.length <= length
        at += r.length
        if r.start == 0:
            parts.append([r.doc_id, b"", r.doc_tokens])
        assert parts[-1][0] == r.doc_id and len(parts[-1][1]) == 4 * r.start
        parts[-1][1] += bytes(r.ids)
    documents = [(str(i), x) for i, x, n in parts]
    assert all(len(x) == 4 * n for _, x, n in parts)
    assert sorted(documents) == sorted((str(i), x.tobytes()) for i, x in encoded(WORD, 1))


def test_sequences_are_padded_but_at_powers_of_two(make_docs):
    docs = make_docs([(i, "hello world") for i in range(10)])  # three ids each
    pieces = packing.pack(docs, WORD, 1, length=8)
    got = sorted(packing.sequences(pieces, pad_id=9, length=8).collect(), key=lambda r: r.sequence_id)
    assert [(r.n_tokens, len(r.ids) // 4) for r in got] == [(8, 8), (8, 8), (8, 8), (6, 8)]
    assert np.frombuffer(got[-1].ids, "<u4")[-2:].tolist() == [9, 9]
    short = packing.sequences(packing.pack(docs.limit(1), WORD, 1, length=8).filter("start < 3"), 9, 8).first()
    assert (short.n_tokens, len(short.ids) // 4) == (3, 8)
    four = packing.sequences(packing.pack(make_docs([(1, "hello world hello")]), WORD, 1, length=8), 9, 8).first()
    assert (four.n_tokens, len(four.ids) // 4) == (4, 4)


def test_empty_tables(make_docs, spark):
    none, root = make_docs([(1, "x")]).limit(0), shared_dir(spark)
    assert packing.pack(none, WORD, 1).count() == 0
    manifest = token_files.write_token_files(none, root, BYTE, 2)
    assert manifest.count() == 0 and token_files.read_token_files(manifest, root).count() == 0


def test_checksums_are_of_unsigned_32_bit_ids(make_docs):
    from pyspark.sql import functions as F

    row = packing.pack(make_docs([(1, "hello world")]), WORD, 1).select(F.crc32("ids").alias("c")).first()
    ids = [*ENCODERS[1].tokenizer.encode("hello world", add_special_tokens=False).ids, 1]
    assert row.c == zlib.crc32(np.array(ids, "<u4").tobytes())
