import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from tidemark.llm import toxicity

BAD = ["idiot", "moron", "stupid", "worthless"]
MISSPELT = ["idiott", "idi0t", "morron", "stupidd", "worthles"]
GOOD = "the a river stone green walks along under quiet letter window garden paper early bright morning".split()


def text(rng, n, bad=()):
    words = [rng.choice(GOOD) + rng.choice(["", "", "s", "ly"]) for _ in range(n)]
    for w in bad:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = int(i % 4 == 0)
        rows.append((i, text(rng, rng.randrange(5, 120), rng.sample(BAD, rng.randrange(1, 3)) if toxic else ())))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark, documents):
    return spark.createDataFrame([*documents[1], (0, None), (None, 1), (99999, 1)], "doc_id bigint, toxic int")


@pytest.fixture(scope="module")
def model(make_docs, documents, labelled):
    rows, table = documents[0], labelled
    return toxicity.fit(make_docs(rows), table, toxicity.learned_fold())


def test_held_out_and_misspelt_words(model, documents):
    rows, labels = documents
    rng = random.Random(9)
    import zlib

    held = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 4 == 2]
    said = model.scores([t for t, _ in held]) >= toxicity.THRESHOLD
    truth = np.array([y for _, y in held]) == 1
    assert said[truth].mean() > 0.9 and said[~truth].mean() < 0.05
    unseen = model.scores([text(rng, 60, [w]) for w in MISSPELT])
    clean = model.scores([text(rng, 60) for _ in MISSPELT])
    assert unseen.min() > clean.max()


def test_few_words_in_a_long_text(model):
    rng = random.Random(10)
    long_clean, long_bad = text(rng, 30_000), text(rng, 30_000, ["idiot"])
    a, b = model.scores([long_clean, long_bad])
    assert a < toxicity.THRESHOLD <= b
    late = long_clean + " " + "stone " * 300_000 + "you idiot moron"
    assert len(late) > toxicity.PART and model.scores([late])[0] >= toxicity.THRESHOLD


def test_scores_of_a_table(model, make_docs, spark):
    rows = [(1, None), (2, ""), (3, " .,"), (4, "you idiot"), (4, "you idiot"), (None, "a stone"), (5, "x")]
    docs = make_docs(rows, clashes=True)
    scored = toxicity.score(docs, model)
    assert scored.select("row.*").schema == docs.schema
    got = {(r.doc_id, r.text): r.score for r in scored.select("row.doc_id", "row.text", "score").collect()}
    assert len(got) == 6 and scored.count() == 7
    assert got[1, None] == got[2, ""] == got[3, " .,"] < toxicity.THRESHOLD <= got[4, "you idiot"]
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fitting_twice_gives_the_same(make_docs, documents, labelled, model):
    again = toxicity.fit(make_docs(documents[0]).repartition(5), labelled.repartition(4), toxicity.learned_fold())
    assert np.array_equal(again.weights, model.weights) and again.offset == model.offset


@pytest.mark.parametrize("labels", [[], [(1, 0), (3, 0)], [(1, 1), (3, 1)]])
def test_without_both_classes(spark, make_docs, labels):
    docs = make_docs([(1, "one text"), (3, "another text")])
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, table, F.lit(True))
    share = sum(y for _, y in labels) / max(1, len(labels))
    assert model.scores(["anything", ""]).tolist() == pytest.approx([share, share], abs=1e-6)


def test_margin_matches_a_plain_loop(model):
    """The highest mean weight over windows of words, n-gram by n-gram."""
    rng = random.Random(2)
    for n in (1, 3, 6, 7, 8, 25):
        sample = text(rng, n, ["moron!"] if n > 3 else ())
        buckets, valids, starts = toxicity._grams(sample)
        best = []
        for first in range(0, max(1, len(starts) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
            begin = starts[first]
            end = starts[first + toxicity.WINDOW] if first + toxicity.WINDOW < len(starts) else len(sample) + 2
            weights = [
                model.weights[b[i]] for b, v in zip(buckets, valids) for i in range(begin, min(end, len(v))) if v[i]
            ]
            best.append(sum(map(float, weights)) / max(1, len(weights)))
        assert toxicity.text_margin(sample, model.weights) == pytest.approx(max(best), abs=1e-5)
