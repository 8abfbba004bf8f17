import hashlib
import re

import pytest

from conftest import rows
from pyspark.sql.readwriter import DataFrameWriter

from documents_fixture import make_docs  # noqa: F401
from tidemark.llm import exact_dedup

TEXTS = [
    (5, "a  b"), (3, "a b"), (9, "a\tb"), (4, "a b"), (7, None), (8, ""), (6, " "), (1, "alone"),
    (2, "\n\r\v"), (10, "a b "), (11, "x" * 3_000_000), (12, "x" * 3_000_000), (3, "a b"), (None, "a b"), (None, "only"),
]


def brute(texts):
    groups = {}
    for i, text in texts:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups.setdefault(hashlib.sha256(plain.encode()).hexdigest(), []).append(i)
    out = []
    for digest, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, digest))
            first = first and i != keep
    return sorted(out, key=str)


def test_report_matches_brute_force(make_docs):
    got = exact_dedup.dedup_report(make_docs(TEXTS, clashes=True))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(TEXTS)


def test_one_of_each_text_stays_with_its_columns(make_docs):
    docs = make_docs(TEXTS, clashes=True)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.schema == docs.schema
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(
        str(i) for i, _, _, keep, _ in brute(TEXTS) if keep
    )


def test_a_hot_group_and_many_texts(make_docs):
    texts = [(i, "the same" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    got = exact_dedup.dedup_report(make_docs(texts))
    assert sorted(map(tuple, got.collect()), key=str) == brute(texts)
    assert exact_dedup.exact_dedup(make_docs(texts)).count() == 2001


def test_a_filter_too_large_to_broadcast(make_docs):
    assert sorted(map(tuple, exact_dedup.dedup_report(make_docs(TEXTS), limit=0).collect()), key=str) == brute(TEXTS)


@pytest.mark.parametrize("limit", [0, 4096, 3 * 4096, 1 << 25])
def test_files_are_taken_in_groups_within_the_limit(make_docs, limit):
    texts = TEXTS + [(i, f"text {i % 170}") for i in range(100, 500)]
    docs = make_docs(texts, clashes=True).repartition(7)
    kept = exact_dedup.exact_dedup(docs, limit=limit)
    assert kept.schema == docs.schema
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(
        str((i, t)) for i, t in kept_texts(texts)
    )


def kept_texts(texts):
    """Of equal texts the row with the smallest id, the text as that row has it."""
    best = {}
    for i, text in texts:
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        if plain not in best or (i is not None and (best[plain][0] is None or i < best[plain][0])):
            best[plain] = (i, text)
    return best.values()


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_texts_never_shuffle(make_docs, spark, monkeypatch, limit):
    """Of every plan that runs, no exchange has a text, or the struct it is kept in, among its columns."""
    seen = []

    def spy(self, *args, _plain=DataFrameWriter.parquet, **more):
        seen.append(explained(self._df))
        return _plain(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    docs = spark.range(300).selectExpr("id doc_id", "concat('some text ', id % 200) text")
    kept = exact_dedup.exact_dedup(docs, limit=limit)
    seen.append(explained(kept))
    assert kept.count() == 200 and len(seen) >= 6
    shuffled = [line for text in seen for line in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", text)]
    assert len(shuffled) >= 4 and not [line for line in shuffled if re.search(r"\b(text|doc)#", line)]
    assert not any("Python" in text or "Arrow" in text for text in seen)


def explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_an_empty_table(make_docs):
    none = make_docs([(1, "x")]).limit(0)
    assert rows(exact_dedup.dedup_report(none)) == [] == rows(exact_dedup.exact_dedup(none))
