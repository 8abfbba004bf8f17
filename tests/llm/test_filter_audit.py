import random
import re
from itertools import permutations

import pytest

from documents_fixture import make_docs  # noqa: F401
from tidemark.llm import filter_audit


def fails(docs):
    """Per row the set of filters it fails, by the words of the contract."""
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        found = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and i > least[text],
        }
        out.append({f for f, fail in found.items() if fail})
    return out


def brute(docs, labels):
    """Each order run filter by filter over the rows."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    rows = [(d[0], d[2] or "", f) for d, f in zip(docs, fails(docs))]
    out = []
    for part in {p for _, p, _ in rows}:
        own = [(i, f) for i, p, f in rows if p == part]
        steps, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, stay = [r for r in left if name in r[1]], [r for r in left if name not in r[1]]
                failing = [r for r in own if name in r[1]]
                sums[name] += len(gone)
                steps.append((
                    part, "".join(order), step, len(stay), len(gone), len(failing) - len(gone), sum(f == {name} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name,
                ))
                left = stay
        out += [(*s[:-1], sums[s[-1]]) for s in steps]
    return sorted(out)


def texts(n, seed):
    draw = random.Random(seed)
    made = []
    for i in range(n):
        words = [draw.choice(["alpha", "Beta", "g", "d$", "ünï", "x" * 9, str(draw.random())]) for _ in range(draw.choice([0, 3, 199, 200, 260]))]
        made.append((i, draw.choice([" ", "\n", "  "]).join(words), draw.choice(["en", "de", None, ""])))
    return made + [(n + i, *draw.choice(made)[1:2], draw.choice(["en", "fr"])) for i in range(n // 2)]


ODD = [
    (1, None, None), (2, "", "en"), (2, "", "en"), (3, "A" * 2_500_000, "en"), (None, "A b", "en"), (None, "A b", "de"), (7, "A b", "de"),
    (4, "word " * 400_000, "en"), (5, "   x", "zz"), (6, "é" * 97 + "ABC", "en"), (8, "é" * 96 + "ABCD", "en"),
]


@pytest.mark.parametrize("docs", [texts(60, 1), texts(90, 2) + ODD, ODD])
def test_every_order_by_brute_force(spark, make_docs, docs):
    labels = [(i, i % 2, int(i % 3 == 0)) for i, *_ in docs if i is not None and i % 5]
    labels += [(2, 0, 1), (2, 1, None), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    table = make_docs([(i, t, lang, "s") for i, t, lang in docs], clashes=True)
    masked = filter_audit.document_failures(table)
    got = filter_audit.audit(filter_audit.weigh(masked, frame))
    assert got.columns == "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)


def test_words_do_not_depend_on_where_a_text_is_cut():
    for _, text, _ in texts(30, 3):
        raw = text.encode()
        assert {filter_audit.word_counts(raw, part) for part in (1, 7, 64, 1 << 20)} == {(len(raw.split()), len(set(raw.split())))}


def test_removal_steps_are_the_first_failing_filter():
    orders, position, steps = filter_audit.removal_steps(4)
    for mask in range(16):
        for o, order in enumerate(orders.tolist()):
            assert steps[mask, o] == next((s for s, f in enumerate(order) if mask >> f & 1), 4)
    assert all(orders[o, position[f, o]] == f for f in range(4) for o in range(24))


def test_texts_do_not_shuffle_and_a_part_is_one_row(spark, make_docs):
    """What the last pass reads is a row per part; a third of all rows share a text and an id."""
    docs = [(i if i % 3 else 7, "same" if i % 3 == 0 else f"text {i}", "en", "s") for i in range(900)]
    masked = filter_audit.document_failures(make_docs(docs))
    assert masked.columns == ["id", "part", "mask"]
    weighed = filter_audit.weigh(masked, spark.createDataFrame([(7, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert weighed.agg({"n": "sum", "good": "sum"}).first()[:] in ((900, 301), (301, 900))
    assert filter_audit.audit(weighed).count() == 600


def test_an_empty_table(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    masked = filter_audit.document_failures(make_docs([(1, "x")]).limit(0))
    assert filter_audit.audit(filter_audit.weigh(masked, labels)).count() == 0
