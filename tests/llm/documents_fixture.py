"""The fixture that makes documents, imported by the tests of this folder."""

import os

import pytest
from conftest import ROOT

# Python workers import the operators from here, wherever pytest was started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))

#: Columns of documents, and others whose names the operators use inside.
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "id int, row string, digest string, n int, key string, copy int, copies int, score double, cls int, maybe boolean"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with clashing columns."""

    def make(rows, clashes=False):
        full = []
        for doc_id, text, *rest in rows:
            lang, source = rest or ("en", "s")
            full.append((doc_id, text, lang, source, len(text or "")))
        if not clashes:
            return spark.createDataFrame(full, DOCUMENTS).repartition(3)
        extra = (1, "r", "d", 2, "k", 3, 4, 0.5, 6, False)
        return spark.createDataFrame([r + extra for r in full], f"{DOCUMENTS}, {CLASHES}").repartition(3)

    return make
