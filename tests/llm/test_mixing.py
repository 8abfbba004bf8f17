import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from tidemark.llm import mixing


def draws(seed, row, rate):
    """Copies of a row (id, text, ...): the inverted distribution, piece by piece."""
    key = hashlib.md5("\x1f".join("null" if v is None else str(v) for v in row[:2]).encode()).hexdigest()
    pieces = max(1, math.ceil(rate / 16))
    mean, total = rate / pieces, 0
    for i in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{key}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        p = below = math.exp(-mean)
        k = 0
        while below <= u and k < 100:
            k += 1
            p *= mean / k
            below += p
            total += 1
    return total


def sources(counts):
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, f"text {i}", "en", source))
            i += 1
    return rows


def expected(rows, rates):
    copies = {row[0]: draws(mixing.SEED, row, rates[row[3]]) for row in rows}
    return Counter({i: n for i, n in copies.items() if n})


@pytest.mark.parametrize("counts", [{"a": 300, "b": 30, None: 3}, {"a": 1}])
def test_copies_match_brute_force(make_docs, counts):
    rows = sources(counts)
    weight = {s: math.sqrt(n) for s, n in counts.items()}
    rates = {s: weight[s] / sum(weight.values()) * len(rows) / n for s, n in counts.items()}
    got = mixing.mix_sources(make_docs(rows, clashes=True)).select("row.doc_id", "copy", "copies").collect()
    assert Counter(r.doc_id for r in got) == expected(rows, rates)
    assert all(1 <= r["copy"] <= r.copies for r in got) and len({(r.doc_id, r["copy"]) for r in got}) == len(got)


def test_target_weights_and_large_rates(make_docs):
    rows = sources({"a": 200, "b": 2, "c": 50})
    docs = make_docs(rows)
    got = mixing.mix_sources(docs, weights={"a": 0.5, "b": 0.5}, total=400)
    counts = Counter(r.doc_id for r in got.select("row.doc_id").collect())
    assert counts == expected(rows, {"a": 1.0, "b": 100.0, "c": 0.0})
    by_source = Counter(r.source for r in got.select("row.source").collect())
    assert abs(by_source["a"] - 200) < 60 and abs(by_source["b"] - 200) < 60 and "c" not in by_source


def test_every_column_comes_along_and_runs_agree(make_docs):
    docs = make_docs([(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "x" * 10**6, "en", "s")], clashes=True)
    mixed = mixing.mix_sources(docs, total=40)
    assert mixed.select("row.*").schema == docs.schema
    again = mixing.mix_sources(docs.repartition(7), total=40)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixed.collect() and [r["copies"] for r in mixed.filter("row.doc_id = 1").collect()]


def test_the_mixture_is_shuffled(make_docs):
    order = [r.doc_id for r in mixing.mix_sources(make_docs(sources({"a": 500}))).select("row.doc_id").collect()]
    rises = sum(a < b for a, b in zip(order, order[1:]))
    assert 0.35 < rises / len(order) < 0.65
    plan = mixing.mix_sources(make_docs(sources({"a": 5})))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_no_weights(make_docs):
    assert mixing.mix_sources(make_docs([(1, "x")]).limit(0)).count() == 0
    assert mixing.mix_sources(make_docs([(1, "x")]), weights={}).count() == 0
    assert mixing.mix_sources(make_docs([(1, "x")]), weights={"other": 1.0}).count() == 0


def test_rows_without_an_id_or_of_one_id_draw_for_themselves(make_docs):
    """Two thirds of the rows have no id, a tenth shares one: no seed loses a group or puts it in one task."""
    rows = [(None if i % 3 else 7 if i % 10 == 0 else i, f"text {i}", "en", "ab"[i % 2]) for i in range(1500)]
    docs = make_docs(rows).cache()
    for seed in range(12):
        mixed = mixing.mix_sources(docs, seed=seed)
        groups = Counter(r.doc_id if r.doc_id in (None, 7) else 0 for r in mixed.select("row.doc_id").collect())
        assert 850 < groups[None] < 1150 and 20 < groups[7] < 90
    assert Counter(r.text for r in mixed.select("row.text").collect()) == Counter(
        {row[1]: n for row in rows if (n := draws(11, row, 1.0))}
    )
    sizes = [r["count"] for r in mixing.mix_sources(docs).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_one_row_of_half_the_weight_is_made_by_many_tasks(make_docs, spark):
    rows = [(1, "rare", "en", "b"), *[(i, f"text {i}", "en", "a") for i in range(2, 50)]]
    mixed = mixing.mix_sources(make_docs(rows), weights={"a": 0.5, "b": 0.5}, total=20_000)
    counts = Counter(r.doc_id for r in mixed.select("row.doc_id").collect())
    assert counts[1] == draws(mixing.SEED, rows[0], 10_000) and abs(counts[1] - 10_000) < 500
    numbered = [r["copy"] for r in mixed.filter("row.doc_id = 1").select("copy").collect()]
    assert sorted(numbered) == list(range(1, counts[1] + 1))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" in plan
