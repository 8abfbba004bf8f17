import random
import re

import numpy as np
import pytest

from documents_fixture import make_docs  # noqa: F401
from plans import explained, shuffled, watch_writes
from tidemark.llm import jaccard_join, shingles
from tidemark.llm.components import components
from tidemark.sources.tables import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(plain)
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width=3, percent=90):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for k, s in enumerate(sets):
        shared = {}
        for e in s:
            for j in lists.setdefault(e, []):
                shared[j] = shared.get(j, 0) + 1
            lists[e].append(k)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    names = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return sorted(((i, len(s), names[root(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def families(seed, count, sizes):
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(99)) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randrange(2, 20)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.choice([0, len(words) - 1, rng.randrange(len(words))])
                kind = rng.random()
                if kind < 0.4:
                    words[at] = f"z{rng.randrange(9)}"
                elif kind < 0.7:
                    words.insert(at, f"y{rng.randrange(9)}")
                elif len(words) > 1:
                    del words[at]
            rows.append((len(rows) * 7919 % 100_003, " ".join(words)))
    return rows


def check(make_docs, rows, clashes=False, **options):
    got = jaccard_join.near_duplicates(make_docs(rows, clashes), **options)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, **options)


def test_families_of_near_copies(make_docs):
    check(make_docs, families(3, 40, [5, 10, 12, 14, 18, 20, 21, 22, 24, 26, 30, 35, 40, 60, 120]), clashes=True)


@pytest.mark.parametrize("boundary", [1, 12, 26])
def test_any_boundary_gives_the_same(make_docs, monkeypatch, boundary):
    monkeypatch.setattr(jaccard_join, "best_boundary", lambda *_: boundary)
    check(make_docs, families(boundary, 25, [8, 12, 20, 23, 25, 30, 45, 90]))


def test_long_lists_in_cells(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CELL", 4)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    check(make_docs, families(8, 25, [20, 40, 80]))


def test_other_widths_and_thresholds(make_docs):
    check(make_docs, families(5, 20, [10, 20, 40]), width=5, percent=80)
    check(make_docs, families(6, 15, [10, 20, 40]), width=1, percent=100)


def test_odd_texts(make_docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, "one\ttwo"), (9, "Ä b c"), (10, "ä b c")]
    rows += [(11, "a b c"), (11, "a b c"), (None, "a b c"), (None, "lonely words here now"), (12, "x " * 400_000), (13, "x " * 300_000)]
    rows += [(20, " ".join(f"w{i}" for i in range(60_000))), (21, " ".join(f"w{i}" for i in range(59_000)))]
    check(make_docs, rows)
    check(make_docs, rows[:3])


def test_a_hot_family_makes_few_pairs(make_docs, monkeypatch):
    """Copies with an edit each: far fewer pairs are checked than the family has."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(150)] = f"edit{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    counts = []
    check_ = jaccard_join._checked
    monkeypatch.setattr(jaccard_join, "_checked", lambda pairs, *a: counts.append(pairs.count()) or check_(pairs, *a))
    check(make_docs, rows)
    assert sum(counts) < 250 * 249 // 20


def test_one_of_each_component_stays(make_docs):
    rows = families(4, 10, [30, 60])
    docs = make_docs(rows, clashes=True)
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_one_row_of_each_component_stays_whatever_the_ids(make_docs, monkeypatch, broadcast):
    """Repeated and NULL ids: no unrelated text goes, no near copy stays."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", broadcast)

    def text(name, edit=""):
        return " ".join([*(f"{name}{i}" for i in range(40)), edit])

    groups = [
        [(3, text("a")), (5, text("a", "near")), (None, text("a", "other"))],
        [(5, text("b"))],
        [(7, text("c")), (7, text("c", "near"))],
        [(None, text("d")), (None, text("d", "near"))],
        [(8, text("e")), (8, text("e")), (9, text("e", "near"))],
        [(None, text("f")), (5, text("f", "near")), (5, text("f", "near"))],
        [(None, text("g"))],
        [(5, "")], [(5, "")], [(None, None)], [(None, None)],
    ]
    docs = make_docs([r for g in groups for r in g], clashes=True)
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(left) == len(groups)
    for group in groups:
        least = min((i for i, _ in group if i is not None), default=None)
        assert any(row in left for row in group if row[0] == least)


def test_texts_that_share_an_id_are_read_once(make_docs, monkeypatch):
    """A text is fetched by itself, not with every other of its id."""
    read, map_ = [], jaccard_join.map_arrow

    def counted(df, function, schema):
        if schema == jaccard_join.SETS:
            read.append(df.count())
        return map_(df, function, schema)

    monkeypatch.setattr(jaccard_join, "map_arrow", counted)
    texts = [" ".join([*(f"{k}w{i}" for i in range(60)), *edit]) for k in range(12) for edit in ([], ["near"])]
    rows = [(i, t) for t in texts for i in (7, None)][::2] + [(None, t) for t in texts[:6]] + [(7, texts[0])]
    check(make_docs, rows)
    assert read and max(read) <= 2 * len(texts)


@pytest.mark.parametrize("limit", [0, 3 * 4096])
def test_files_are_taken_in_groups_within_the_limit(make_docs, limit):
    rows = families(9, 12, [20, 40, 80])
    docs = make_docs(rows, clashes=True).repartition(5)
    assert sorted(map(tuple, jaccard_join.near_duplicates(docs, limit=limit).collect()), key=str) == brute(rows)
    kept = jaccard_join.drop_near_duplicates(docs, limit=limit)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_texts_never_shuffle(make_docs, monkeypatch):
    """Of every plan that runs, no exchange has a text, or the struct it is kept in, among its columns."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rows = families(10, 6, [20, 40])
    docs = materialise(make_docs(rows))  # the fixture deals its rows
    seen = watch_writes(monkeypatch)
    for limit in (0, 1 << 25):
        seen.append(explained(jaccard_join.drop_near_duplicates(docs, limit=limit)))
    lines = shuffled(seen)
    assert len(lines) > 20 and not [line for line in lines if re.search(r"\b(text|doc)#", line)]


def test_an_empty_table(make_docs):
    none = make_docs([(1, "x")]).limit(0)
    assert jaccard_join.near_duplicates(none).count() == 0
    assert jaccard_join.drop_near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_hashes_do_not_depend_on_parts(monkeypatch):
    text = " ".join(f"Word{i}é" for i in range(500)) + "\n tail"
    whole = shingles.shingle_set(text, 3)
    monkeypatch.setattr(shingles, "PART", 50)
    assert np.array_equal(shingles.shingle_set(text, 3), whole)
    assert len(whole) == len(shingle_set(text, 3))


def test_the_boundary_follows_the_cost():
    rule, flat = jaccard_join.Rule(90), np.ones(1 << 10, "u8")
    # Without shared shingles a place in a list costs less than a subset; with them it does not.
    assert jaccard_join.best_boundary({10: 1000, 100: 10}, flat, rule) < 9
    assert jaccard_join.best_boundary({40: 1000}, flat, rule) < 36
    hot = flat.copy()
    hot[0] = 1 << 30
    assert jaccard_join.best_boundary({24: 1000}, hot, rule) >= 24
    assert jaccard_join.best_boundary({}, np.zeros(4, "u8"), rule) >= 1
