"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags the tokens of a text as begin, inside or outside of a secret. Tokens are runs of
letters, digits, ``_``, ``+``, ``/`` and ``-``, and single other characters. Features are the
shape (kinds of characters, length, how often the kinds change) and word of a token and of its
neighbours, and of the file its length and how many long mixed tokens it has. It is trained in
numpy by forward and backward sums on a bounded sample, tagged by the patterns: at most
``SAMPLE`` texts with a match and ``SAMPLE`` others, by the hash of their id, of each at most
``WINDOWS`` windows. Whole texts are decoded by Viterbi, many at a time: a text is cut into
chunks, each chunk is solved for every tag before it, and the chunks are then joined, which
gives the best path of the whole text.

Offsets are code points. Spans of the patterns always stay; decoded spans of ``MIN_SPAN``
characters or more are added, as kind ``crf``, where they touch none of them. A NULL text is
empty and has no span; rows that repeat an id are scanned each. Without anything to learn from
nothing is added. Very long texts are tagged in parts of ``PART`` characters, cut at white
space.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices, texts_of
from tidemark.sources.tables import materialise, scratch

# The patterns, in the order of their kinds, and the least lengths of a match.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: What a text must hold for a match, for sampling.
LIKELY = r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{12}"

SAMPLE = 600
WINDOWS, WINDOW = 3, 128
STEPS, RATE, DECAY = 30, 0.5, 1e-4
MIN_SPAN = 8
CHUNK = 256
PART = 1 << 20
SEED = 11

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SHAPES, WORD_BITS = 2048, 13
#: Feature tables: shape of the token, before, after; length and changes alone; word of the
#: token, before, two before, after; the file's length and its number of long mixed tokens.
SIZES = (SHAPES, SHAPES, SHAPES, 32, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 1 << WORD_BITS, 24, 4)

SPANS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"

_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(rf"{HEX[:-1]}{{{LEAST['hex']},}}")


@cache
def _kinds() -> np.ndarray:
    """Per code point below 129 (the last for all others): 0 space, 1 other, 2 a-f, 3 g-z, 4 A-Z,
    5 digit, 6 joiner, 7 beyond ASCII."""
    kind = np.ones(129, "u1")
    kind[[*range(9, 14), *range(28, 33)]] = 0
    kind[97:103], kind[103:123], kind[65:91], kind[48:58] = 2, 3, 4, 5
    kind[[ord(c) for c in "_+/-"]] = 6
    kind[128] = 7
    return kind


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    ups, downs = np.full(2 * PART, base, "u8"), np.full(2 * PART, pow(base, -1, 1 << 64), "u8")
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


class Tokens:
    """Tokens of a text: where they start and end, and their feature values."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = _kinds()[np.minimum(codes, 128)]
        word, other = kind > 1, kind == 1
        edge = np.concatenate([[False], word, [False]])
        self.start = np.flatnonzero((word & ~edge[:-2]) | other)
        self.end = np.flatnonzero((word & ~edge[2:]) | other) + 1
        self.hexes = self._long_runs((kind == 2) | (kind == 5), LEAST["hex"])
        self._features(codes, kind)

    @staticmethod
    def _long_runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
        change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view("i1"), [0]])))
        begin, end = change[::2], change[1::2]
        long_ = end - begin >= least
        return list(zip(begin[long_].tolist(), end[long_].tolist()))

    def _features(self, codes: np.ndarray, kind: np.ndarray) -> None:
        start, end = self.start, self.end
        n = len(start)

        def count(mask: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(mask) + 1, "i4")
            np.cumsum(mask, out=sums[1:])
            return sums[end] - sums[start]

        size = (end - start).astype("i4")
        low, lower, upper, digit, joiner, beyond = (count(kind == k) for k in (2, 3, 4, 5, 6, 7))
        family = np.where(kind == 2, 3, kind)
        changed = np.zeros(len(kind), bool)
        changed[1:] = (family[1:] != family[:-1]) & (kind[1:] > 1) & (kind[:-1] > 1)
        changes = count(changed)
        length = np.searchsorted([4, 8, 12, 16, 20, 32, 40], size, side="right")
        hexes = (low + digit == size) & (size > 0)
        flags = (
            hexes * 1 + (low + lower > 0) * 2 + (upper > 0) * 4 + (digit > 0) * 8 + (joiner > 0) * 16 + (beyond > 0) * 32
        )
        changes = np.searchsorted([1, 3, 6], changes, side="right")
        shape = (length * 64 + flags) * 4 + changes
        ups, downs = _powers()
        small = np.where((codes >= 65) & (codes <= 90), codes + np.uint32(32), codes).astype("u8") + np.uint64(1)
        sums = np.zeros(len(codes) + 1, "u8")
        np.cumsum(small * ups[: len(codes)], out=sums[1:])
        hashed = (sums[end] - sums[start]) * downs[start] * np.uint64(0x9E3779B97F4A7C15)
        word = (hashed >> np.uint64(64 - WORD_BITS)).astype("i4")
        # Of long tokens and those with digits only the shape counts.
        word[(size > 16) | (digit > 0)] = 0
        mixed = int(((size >= 12) & (digit > 0) & (low + lower + upper > 0)).sum())
        file_length = min(23, len(codes).bit_length())

        def shifted(values: np.ndarray, by: int) -> np.ndarray:
            moved = np.zeros(n, values.dtype)
            if by > 0:
                moved[by:] = values[:-by] if n > by else values[:0]
            elif n:
                moved[:by] = values[-by:]
            return moved

        self.features = (
            shape, shifted(shape, 1), shifted(shape, -1), length * 4 + changes,
            word, shifted(word, 1), shifted(word, 2), shifted(word, -1),
            np.full(n, file_length), np.full(n, min(3, mixed)),
        )


def base_spans(text: str, hexes: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the patterns' matches, in order; where their secret parts are."""
    found, values = [], []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST["access"]:
                found.append((m.start(), 1, m.end()))
    found += [(a, 2, b) for a, b in hexes]
    values += [(a, b) for a, kind, b in found if kind]
    return sorted(found), sorted(values)


class Field:
    """The field's weights: a table per feature, and transitions from tag to tag."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray):
        self.tables, self.moves = tables, moves

    @classmethod
    def blank(cls) -> "Field":
        return cls([np.zeros((n, 3), "f4") for n in SIZES], np.zeros((3, 3), "f4"))

    def emissions(self, features) -> np.ndarray:
        total = self.tables[0][features[0]]
        for table, values in zip(self.tables[1:], features[1:]):
            total += table[values]
        return total

    def to_bytes(self) -> bytes:
        return b"".join(t.astype("<f4").tobytes() for t in [*self.tables, self.moves])

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Field":
        flat, tables, at = np.frombuffer(raw, "<f4"), [], 0
        for n in (*SIZES, 3):
            tables.append(flat[at : at + 3 * n].reshape(n, 3))
            at += 3 * n
        return cls(tables[:-1], tables[-1])


def viterbi(emissions: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best tags of each sequence; before the first token stands an outside tag."""
    lengths = np.array([len(e) for e in emissions], "i8")
    counts = -(-lengths // CHUNK)
    total = int(counts.sum())
    if not total:
        return [np.empty(0, "i1") for _ in emissions]
    scores = np.zeros((CHUNK, total, 3), "f4")
    valid = np.zeros((CHUNK, total), bool)
    first = np.cumsum(counts) - counts
    for e, c, n in zip(emissions, first.tolist(), counts.tolist()):
        if n:
            padded = np.zeros((n * CHUNK, 3), "f4")
            padded[: len(e)] = e
            scores[:, c : c + n] = padded.reshape(n, CHUNK, 3).transpose(1, 0, 2)
            there = np.zeros(n * CHUNK, bool)
            there[: len(e)] = True
            valid[:, c : c + n] = there.reshape(n, CHUNK).T
    # best[s][y]: of the chunk's paths that come from tag s and end in y.
    best = [[moves[s, y] + scores[0, :, y] for y in range(3)] for s in range(3)]
    back = np.empty((CHUNK, 3, 3, total), "i1")
    for t in range(1, CHUNK):
        on = valid[t]
        if not on.any():
            back[t:] = np.arange(3, dtype="i1")[None, None, :, None]
            break
        for s in range(3):
            a, b, c = best[s]
            new = []
            for y in range(3):
                via0, via1, via2 = a + moves[0, y], b + moves[1, y], c + moves[2, y]
                top = np.maximum(np.maximum(via0, via1), via2)
                source = np.where(via0 == top, 0, np.where(via1 == top, 1, 2))
                back[t, s, y] = np.where(on, source, y)
                new.append(np.where(on, top + scores[t, :, y], best[s][y]))
            best[s] = new
    chunk = np.array([[best[s][y] for y in range(3)] for s in range(3)])
    # Join the chunks of each sequence, the jth chunks of all sequences at a time.
    value = np.full((len(emissions), 3), -np.inf)
    value[:, OUTSIDE] = 0
    source = np.zeros((total, 3), "i1")
    for j in range(int(counts.max())):
        has = np.flatnonzero(counts > j)
        at = first[has] + j
        options = value[has][:, :, None] + chunk[:, :, at].transpose(2, 0, 1)
        source[at] = options.argmax(axis=1)
        value[has] = options.max(axis=1)
    ends, befores = np.zeros(total, "i1"), np.zeros(total, "i1")
    tag = value.argmax(axis=1)
    for j in range(int(counts.max()) - 1, -1, -1):
        has = np.flatnonzero(counts > j)
        at = first[has] + j
        ends[at] = tag[has]
        tag[has] = source[at, tag[has]]
        befores[at] = tag[has]
    tags = np.empty((CHUNK, total), "i1")
    every = np.arange(total)
    tags[CHUNK - 1] = ends
    for t in range(CHUNK - 1, 0, -1):
        tags[t - 1] = back[t, befores, tags[t], every]
    return [tags[:, c : c + n].T.ravel()[:k] for c, n, k in zip(first.tolist(), counts.tolist(), lengths.tolist())]


def train(windows: list[tuple[list[np.ndarray], np.ndarray]]) -> Field:
    """Fits the field to tagged windows (feature values, tags) of up to ``WINDOW`` tokens, by
    gradient ascent with a step size per weight."""
    field = Field.blank()
    if not windows:
        field.tables[0][:, OUTSIDE] = 1
        return field
    n = len(windows)
    features = np.zeros((len(SIZES), n, WINDOW), "i4")
    tags, on = np.zeros((n, WINDOW), "i4"), np.zeros((n, WINDOW), bool)
    for i, (values, own) in enumerate(windows):
        features[:, i, : len(own)] = values
        tags[i, : len(own)], on[i, : len(own)] = own, True
    flat = [f[on] for f in features]
    truth = np.eye(3, dtype="f4")[tags]
    before = np.concatenate([np.zeros((n, 1), "i4"), tags[:, :-1]], axis=1)
    moved = np.zeros((3, 3))
    np.add.at(moved, (before[on], tags[on]), 1)
    seen = [np.full((k, 3), 1e-6, "f4") for k in (*SIZES, 3)]
    for _ in range(STEPS):
        scores = np.zeros((n, WINDOW, 3), "f4")
        scores[on] = field.emissions(flat)
        share, moves = _expected(scores, field.moves, on)
        slopes = [np.stack([np.bincount(f, (truth[on] - share[on])[:, y], k) for y in range(3)], axis=1) for f, k in zip(flat, SIZES)]
        slopes.append(moved - moves)
        for weights, slope, s in zip([*field.tables, field.moves], slopes, seen):
            slope = slope.astype("f4") - DECAY * n * weights
            s += slope * slope
            weights += RATE * slope / np.sqrt(s)
    return field


def _expected(scores: np.ndarray, moves: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every tag of every token, and the expected number of every move."""
    n, length, _ = scores.shape
    factor = np.exp(moves - moves.max())
    local = np.exp(scores - scores.max(axis=2, keepdims=True)).astype("f8")
    ahead, behind = np.zeros((length + 1, n, 3)), np.ones((length + 1, n, 3))
    ahead[0, :, OUTSIDE] = 1
    for t in range(length):
        step = (ahead[t] @ factor) * local[:, t]
        ahead[t + 1] = np.where(on[:, t, None], step / step.sum(axis=1, keepdims=True), ahead[t])
    for t in range(length - 1, -1, -1):
        step = (behind[t + 1] * local[:, t]) @ factor.T
        behind[t] = np.where(on[:, t, None], step / step.sum(axis=1, keepdims=True), behind[t + 1])
    share = ahead[1:] * behind[1:]
    share /= share.sum(axis=2, keepdims=True)
    total = np.zeros((3, 3))
    for t in range(length):
        pair = ahead[t][:, :, None] * factor * (local[:, t] * behind[t + 1])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        total += pair[on[:, t]].sum(axis=0)
    return share.transpose(1, 0, 2), total


def tagged_windows(text: str, rng: np.random.Generator) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """Windows of a text to learn from: around the patterns' matches, and others."""
    _, values = base_spans(text, [m.span() for m in _HEX.finditer(text)])

    def tagged(offset: int, part: str) -> tuple[Tokens, np.ndarray]:
        end, tokens = offset + len(part), Tokens(part)
        own = [(max(a, offset) - offset, min(b, end) - offset) for a, b in values if a < end and b > offset]
        return tokens, _tags(tokens, own)

    # Tokens of a long text are made twice, so that those of one part are held at a time.
    counts, begins = [0], []
    for offset, part in _parts(text):
        tokens, tags = tagged(offset, part)
        begins.append(np.flatnonzero(tags == BEGIN) + counts[-1])
        counts.append(counts[-1] + len(tokens.start))
    count = counts[-1]
    if not count:
        return []
    begins = np.concatenate(begins)
    middles = begins[np.linspace(0, len(begins) - 1, min(len(begins), WINDOWS)).astype(int)] if len(begins) else begins
    # Of a window around a match, the part that holds the match.
    starts = [max(counts[np.searchsorted(counts, m, side="right") - 1], int(m) - WINDOW // 2) for m in middles]
    starts += rng.integers(0, max(1, count - WINDOW), max(1, WINDOWS - len(starts))).tolist()
    found = {}
    for (offset, part), first, last in zip(_parts(text), counts, counts[1:]):
        wanted = [s for s in dict.fromkeys(starts) if first <= s < last]
        if wanted:
            tokens, tags = tagged(offset, part)
            found |= {s: ([f[s - first : s - first + WINDOW] for f in tokens.features], tags[s - first : s - first + WINDOW]) for s in wanted}
    return [found[s] for s in dict.fromkeys(starts)]


def _tags(tokens: Tokens, values: list[tuple[int, int]]) -> np.ndarray:
    tags = np.zeros(len(tokens.start), "i4")
    for begin, end in values:
        a = int(np.searchsorted(tokens.end, begin, side="right"))
        b = int(np.searchsorted(tokens.start, end))
        if a < b and not tags[a:b].any():
            tags[a], tags[a + 1 : b] = BEGIN, INSIDE
    return tags


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Field:
    """Learns the field from the sample of ``docs``, in one task."""
    with scratch(docs.sparkSession):
        return _fit(docs, id_column, text_column)


def _fit(docs: DataFrame, id_column: str, text_column: str) -> Field:
    place = F.xxhash64(F.lit(SEED), F.col(id_column))
    known = docs.filter(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    marked = known.select(F.col(id_column).alias("id"), place.alias("place"), F.col(text_column).rlike(LIKELY).alias("likely"))
    picks = [marked.filter(F.col("likely") == c).orderBy("place", "id").limit(SAMPLE) for c in (True, False)]
    # At most 2 * SAMPLE ids; ids that many rows share can't raise the number of texts.
    ids = materialise(picks[0].unionByName(picks[1]).select("id").distinct())
    texts = known.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(ids), "id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((str(r["id"]), r["text"]) for b in batches for s in slices(b, "text") for r in s.to_pylist())
        rng = np.random.default_rng(SEED)
        field = train([w for _, text in rows for w in tagged_windows(text, rng)])
        yield pa.RecordBatch.from_pydict({"field": [field.to_bytes()]})

    found = map_arrow(texts.limit(2 * SAMPLE).repartition(1), learn, "field binary").first()
    return Field.from_bytes(found.field) if found else train([])


def _parts(text: str) -> Iterator[tuple[int, str]]:
    start = 0
    while start < len(text):
        end = min(len(text), start + PART)
        while end < min(len(text), start + 2 * PART) and not text[end].isspace():
            end += 1
        yield start, text[start:end]
        start = end


def scan_texts(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """Per text the patterns' spans (start, kind, end) and the spans that the field adds."""
    tokens, owners, offsets, hexes = [], [], [], []
    for i, text in enumerate(texts):
        for offset, part in _parts(text):
            tokens.append(Tokens(part))
            owners.append(i)
            offsets.append(offset)
        # A run may lie across the cuts of a text.
        whole = bool(text) and len(part) == len(text)
        hexes.append(tokens[-1].hexes if whole else [m.span() for m in _HEX.finditer(text)])
    added: list[list[tuple[int, int]]] = [[] for _ in texts]
    paths = viterbi([field.emissions(t.features) for t in tokens], field.moves)
    for t, i, offset, path in zip(tokens, owners, offsets, paths):
        inside = path != OUTSIDE
        if inside.any():
            edges = np.concatenate([[False], inside, [False]])
            begin = np.flatnonzero(inside & (~edges[:-2] | (path == BEGIN)))
            last = np.concatenate([begin[1:], [len(path)]])
            for a, b in zip(begin, last):
                stop = a + int(np.argmin(np.concatenate([inside[a:b], [False]])))
                added[i].append((offset + int(t.start[a]), offset + int(t.end[stop - 1])))
    results = []
    for text, own_hexes, own in zip(texts, hexes, added):
        base, _ = base_spans(text, own_hexes)
        results.append((base, apart([(a, b) for a, b in own if b - a >= MIN_SPAN], base)))
    return results


def apart(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The ``spans`` that overlap none of ``base``: of those that start before a span's end, the one
    that reaches farthest decides, so each span takes one look-up."""
    ordered = sorted(base)
    starts, reach = [s for s, _, _ in ordered], list(accumulate((e for _, _, e in ordered), max))
    free = []
    for a, b in spans:
        before = bisect_left(starts, b)
        if not before or reach[before - 1] <= a:
            free.append((a, b))
    return free


def scan(docs: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the number of matches of each pattern, ``base`` (their spans) and ``spans``
    (all spans), as kind:start:end by start, then kind, joined by commas."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                rows = []
                for base, added in scan_texts(texts_of(piece.column("text")), field):
                    every = sorted(base + [(a, len(KINDS), b) for a, b in added])
                    kinds = [k for _, k, _ in base]
                    rows.append([*(kinds.count(k) for k in range(3)), _joined(base), _joined(every)])
                columns = list(zip(*rows)) if rows else [()] * 5
                types = [pa.int64()] * 3 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                    names=[c.split()[0] for c in SPANS.split(", ")],
                )

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return map_arrow(picked, read, SPANS)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "crf")
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)
