import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from tidemark.llm import fingerprints

M = fingerprints.SAMPLES


def shingles(text):
    """Spark's chained hash of each five words, with their number."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    found = Counter()
    for i in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        found[h] += 1
    return found


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def brute_print(text, r_table, c_table):
    codes = []
    for i in range(M):
        least = None
        for term, n in shingles(text).items():
            h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<Q", term), 42))
            r, c, b = r_table[h & 4095], c_table[h >> 12 & 4095], (h >> 32) / 2**32
            a = c - r * (math.floor(math.log(n) / r + b) + 1 - b)
            least = a if least is None else min(a, least)
        codes.append(42 if least is None else xxhash.xxh64_intdigest(struct.pack("<d", least), 42) & 0xFFFF)
    return "".join(f"{c:04x}" for c in codes)


def same(a, b):
    return sum(a[4 * i : 4 * i + 4] == b[4 * i : 4 * i + 4] for i in range(M)) / M


def brute(docs, r_table, c_table):
    digest = lambda d: hashlib.sha256(f"{'n' if d[0] is None else f'i{d[0]}'}:{d[1] or ''}".encode()).digest()
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, digest(d)), reverse=True)
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (brute_print(t, r_table, c_table) for t in (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, same(a, b), same(a, c)))
    return sorted(out, key=str)


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["ünï", "日本", "x" * 40]
    return [(i, draw.choice([" ", "\n "]).join(draw.choices(words, k=draw.choice([0, 1, 4, 5, 6, 60, 150])))) for i in range(n)]


ODD = [
    (None, None), (None, "a b"), (3, "a b c d e " * 30), (3, "a b c d e " * 30), (3, "other"), (5, ""), (5, ""), (5, ""), (6, "  \n"),
    (9, "lorem ipsum " * 3), (-4, "日本" * 40), (8, "a b"),
]


@pytest.fixture(scope="module")
def tables(spark):
    r, c = fingerprints._tables(spark)
    return spark.range(1).select(r.alias("r"), c.alias("c")).first()


@pytest.mark.parametrize("docs", [texts(40, 1), texts(25, 2) + ODD, ODD, [(1, "a b c d e f g")], [(1, "x y")] * 5])
def test_all_columns_by_brute_force(make_docs, tables, docs):
    got = fingerprints.compare(make_docs(docs, clashes=True))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, *tables)


def test_likeness_estimates_generalised_jaccard(spark):
    draw = random.Random(3)
    base = [f"w{draw.randrange(300)}" for _ in range(400)]
    rows, pairs = [], []
    for k in range(40):
        at = 10 * k
        near = base[:at] + [f"v{draw.randrange(300)}" for _ in range(400 - at)] + base[:20] * draw.randrange(4)
        rows.append((k, " ".join(near)))
        pairs.append(jaccard(shingles(" ".join(base)), shingles(rows[-1][1])))
    made = fingerprints.fingerprints(spark.createDataFrame([(99, " ".join(base)), *rows], "i int, text string"), samples=512)
    prints = {r.i: r["print"] for r in made.collect()}
    estimates = [sum(prints[99][2 * j : 2 * j + 2] == prints[k][2 * j : 2 * j + 2] for j in range(512)) / 512 for k in range(40)]
    errors = [a - b for a, b in zip(estimates, pairs)]
    assert max(map(abs, errors)) < 0.09 and abs(sum(errors) / 40) < 0.02


def test_weights_count_and_not_only_sets(spark):
    """The same set of shingles at other weights is less alike, as generalised Jaccard has it."""
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words)), (1, " ".join(words * 4))]
    made = fingerprints.fingerprints(spark.createDataFrame(rows, "i int, text string"), samples=512).orderBy("i").collect()
    a, b = (r["print"] for r in made)
    same_ = sum(a[2 * j : 2 * j + 2] == b[2 * j : 2 * j + 2] for j in range(512)) / 512
    assert abs(same_ - jaccard(*[shingles(t) for _, t in rows])) < 0.07


def test_very_long_texts_and_many_ranges(spark, make_docs, tables):
    docs = [(1, "b " * 1_000_000), (2, "c" * 2_000_000), (3, "d e f")]
    got = {r.doc_id: r for r in fingerprints.compare(make_docs(docs)).collect()}
    assert got[1].edited_sha256 == hashlib.sha256(("b " * 500_000 + "d e f").encode()).hexdigest()
    assert got[2].fingerprint == brute_print(docs[1][1], *tables) and got[3].n_chars == 5
    many = [(i * 7 % 1009, f"text number {i * 7 % 1009} " * 3) for i in range(1009)]
    links = fingerprints.neighbours(fingerprints._rows(make_docs(many).repartition(16), "doc_id", "text"))
    keys = {r.key: r.id for r in links.collect()}
    assert {r.id: keys[r.user] for r in links.collect()} == {i: (i + 1) % 1009 for i in range(1009)}


def test_a_hot_row_is_one_text_until_its_copies_are_written(make_docs, monkeypatch, tables):
    monkeypatch.setattr(fingerprints, "PIECE", 7)
    docs = [(4, "the hot row of many words here")] * 300 + texts(20, 5)
    assert sorted(map(tuple, fingerprints.compare(make_docs(docs)).collect()), key=str) == brute(docs, *tables)


def test_no_python_and_no_text_dealt_out_twice(make_docs):
    docs = make_docs(texts(30, 6))
    rows = fingerprints._rows(docs, "doc_id", "text")
    plan = fingerprints.fingerprints(rows.select("key", "text").repartition(3, "key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("SinglePartition") <= 2 and "Python" not in plan and "Arrow" not in plan


def test_an_empty_table(make_docs):
    assert fingerprints.compare(make_docs([(1, "x")]).limit(0)).count() == 0
