"""Toxicity by subword bags: character n-gram embeddings, averaged into a linear softmax.

A word's character 3- to 5-grams, with marks at its ends, hash into ``1 << BUCKET_BITS``
vectors. Their average over a window of ``WINDOW`` words goes through a linear softmax, and
vectors and softmax are trained jointly, in numpy. A misspelt or inflected word that was never
seen shares most n-grams, and so most vectors, with those that were.

A text scores as its worst window, so a few words are not drowned by a long text: every window
of the whole text is scored, in steps of ``STEP`` words. In training likewise: after first
rounds in which all windows of a toxic text count as toxic, only the worst one does. Part of the
sample is held back to turn window scores into the probability of a text.

The sample is bounded: ``MAX_LABELLED`` labelled texts per class by the hash of their id, of
each at most ``MAX_WINDOWS`` evenly spaced windows. It is fitted in one task. After that
vectors and softmax fold into one number per n-gram, 1 MB that scoring tasks carry along.

NULL and empty texts get the score of a text without evidence, rows that repeat an id are
scored each. Without labels of both classes every score is the share of toxic labels, or 0.
Labels that are NULL are not used; of labels that repeat an id each counts.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_crc32, map_arrow, row_struct, slices, small_batches
from tidemark.sources.tables import materialise, scratch

#: Words of a window, and the step between windows.
WINDOW, STEP = 6, 2
GRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIMENSIONS = 8
MAX_LABELLED = 2500
MAX_WINDOWS = 128
#: Share of the sample that calibrates instead of training, as one in so many texts.
CALIBRATE_EVERY = 5
#: Rounds over the sample, of which in the first ones every window of a toxic text counts as toxic.
EPOCHS, ALL_EPOCHS = 12, 5
RATE = 0.5
DECAY = 1e-4
BATCH = 512
#: Texts are read in parts of so many characters, which overlap by ``OVERLAP``.
PART, OVERLAP = 1 << 20, 1 << 12
THRESHOLD = 0.3
SEED = 7

_PUNCTUATION = ".,;:!?\"()[]{}<>|/"
_SEPARATOR = np.array([chr(c).isspace() or chr(c) in _PUNCTUATION for c in range(0x3001)])


def _parts(text: str) -> Iterator[str]:
    for start in range(0, max(1, len(text)), PART):
        yield text[max(0, start - OVERLAP) : start + PART]


def _grams(text: str) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per n the bucket at each place of the text and whether an n-gram starts there; the
    places where words start. Places count from a mark before the text."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    apart = np.zeros(len(codes), bool)
    low = codes < len(_SEPARATOR)
    apart[low] = _SEPARATOR[codes[low]]
    letters = np.where(apart, np.uint32(0), codes + np.uint32(1))
    inside = ~apart
    starts = np.flatnonzero(inside[1:] & apart[:-1])
    length = len(codes)
    hashed, valid = letters.astype("u4"), np.ones(length, bool)
    buckets, valids = [], []
    for n in range(2, max(GRAMS) + 1):
        if length < n:
            break
        size = length - n + 1
        hashed = hashed[:size] * np.uint32(0x01000193) ^ letters[n - 1 :]
        valid = valid[:size] if n == 2 else valid[:size] & inside[n - 2 : n - 2 + size]
        if n in GRAMS:
            mixed = (hashed + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)
            buckets.append(mixed >> np.uint32(32 - BUCKET_BITS))
            valids.append(valid)
    return buckets, valids, starts


def _edges(starts: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of the windows of a text."""
    first = np.arange(0, max(1, len(starts) - WINDOW + step), step)
    begin = starts[first]
    last = first + WINDOW
    end = np.where(last < len(starts), starts[np.minimum(last, len(starts) - 1)], length)
    return begin, end


def text_margin(text: str, weights: np.ndarray) -> float:
    """The highest mean weight of n-grams over the windows of a text; 0 without a word."""
    best = -np.inf
    for part in _parts(text):
        buckets, valids, starts = _grams(part)
        if not len(starts) or not buckets:
            continue
        length = len(valids[0]) + GRAMS[0] - 1
        total, count = np.zeros(length), np.zeros(length, "i4")
        for bucket, valid in zip(buckets, valids):
            total[: len(valid)] += np.where(valid, weights[bucket], 0.0)
            count[: len(valid)] += valid
        total = np.concatenate([[0.0], np.cumsum(total)])
        count = np.concatenate([[0], np.cumsum(count)])
        begin, end = _edges(starts, length, STEP)
        mean = (total[end] - total[begin]) / np.maximum(1, count[end] - count[begin])
        best = max(best, float(mean.max()))
    return best if best > -np.inf else 0.0


def _windows(text: str) -> list[np.ndarray]:
    """The buckets of up to ``MAX_WINDOWS`` windows side by side, evenly spaced."""
    found = []
    for part in _parts(text):
        buckets, valids, starts = _grams(part)
        if not len(starts) or not buckets:
            continue
        begin, end = _edges(starts, len(valids[0]) + GRAMS[0] - 1, WINDOW)
        for a, b in zip(begin, end):
            found.append(np.concatenate([x[a:b][v[a:b]] for x, v in zip(buckets, valids)]).astype("i4"))
    found = [w for w in found if len(w)]
    if len(found) > MAX_WINDOWS:
        found = [found[i] for i in np.linspace(0, len(found) - 1, MAX_WINDOWS).astype(int)]
    return found


class Bags:
    """Windows of texts as one array of buckets, with the text each window belongs to."""

    def __init__(self, texts: list[str]):
        windows = [_windows(t) for t in texts]
        self.owner = np.repeat(np.arange(len(texts)), [len(w) for w in windows])
        flat = [w for ws in windows for w in ws]
        self.size = np.array([len(w) for w in flat], "i8")
        self.start = np.cumsum(self.size) - self.size
        self.bucket = np.concatenate(flat) if flat else np.empty(0, "i4")

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of some windows, where each starts among them, and their sizes."""
        size = self.size[which]
        start = np.cumsum(size) - size
        at = np.repeat(self.start[which] - start, size) + np.arange(int(size.sum()))
        return self.bucket[at], start, size

    def margins(self, weights: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(weights[self.bucket], self.start)
        return sums / self.size


def train(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """The folded weight of every bucket: its vector times the softmax's difference of classes."""
    rng = np.random.default_rng(SEED)
    bags = Bags(texts)
    size = 1 << BUCKET_BITS
    vectors = rng.uniform(-0.5, 0.5, (size, DIMENSIONS)).astype("f4") / DIMENSIONS
    softmax = np.zeros((DIMENSIONS, 2), "f4")
    softmax[:, 1] = rng.uniform(-0.5, 0.5, DIMENSIONS)
    bias = np.zeros(2, "f4")
    seen_v, seen_s = np.full(size, 1e-8, "f4"), np.full((DIMENSIONS, 2), 1e-8, "f4")
    toxic = labels[bags.owner] == 1
    touched = np.zeros(size, bool)
    touched[bags.bucket] = True
    for epoch in range(EPOCHS):
        use = np.ones(len(bags.size), bool)
        if epoch >= ALL_EPOCHS:
            margin = bags.margins(_folded(vectors, softmax))
            use = ~toxic | _worst(bags.owner, margin)
        order = rng.permutation(np.flatnonzero(use))
        weight = {c: 0.5 * len(order) / max(1, int((toxic[order] == c).sum())) for c in (False, True)}
        for begin in range(0, len(order), BATCH):
            which = order[begin : begin + BATCH]
            bucket, start, n = bags.pick(which)
            mean = np.add.reduceat(vectors[bucket], start) / n[:, None]
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            truth = toxic[which]
            p[np.arange(len(which)), truth.astype(int)] -= 1
            p *= np.where(truth, weight[True], weight[False])[:, None].astype("f4") / len(which)
            away = softmax[:, 1] - softmax[:, 0]
            # Both classes pull a vector along the same line, so one number per bucket says it.
            pull = np.bincount(bucket, np.repeat(p[:, 1] / n, n), size).astype("f4") * len(which)
            seen_v += pull * pull
            step = RATE * pull / np.sqrt(seen_v + 1e-6)
            vectors -= step[:, None] * away + DECAY * vectors
            slope = mean.T @ p
            seen_s += slope * slope
            softmax -= 0.1 * RATE * slope / np.sqrt(seen_s + 1e-6)
            bias -= RATE * p.sum(axis=0)
    return np.where(touched, _folded(vectors, softmax), 0).astype("f4")


def _folded(vectors: np.ndarray, softmax: np.ndarray) -> np.ndarray:
    return vectors @ (softmax[:, 1] - softmax[:, 0])


def _worst(owner: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """The window with the highest margin of every text."""
    order = np.lexsort((-margin, owner))
    first = np.ones(len(order), bool)
    first[1:] = owner[order][1:] != owner[order][:-1]
    worst = np.zeros(len(order), bool)
    worst[order[first]] = True
    return worst


def calibrate(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to labels, weighted so that a share
    of ``share`` of the texts is toxic; the slope is kept from running away."""
    mean, spread = float(margins.mean()), float(margins.std()) or 1.0
    x = (margins - mean) / spread
    n1 = max(1, int(labels.sum()))
    w = np.where(labels == 1, share / n1, (1 - share) / max(1, len(labels) - n1)) * len(labels)
    a, b = 1.0, float(np.log(share / (1 - share)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        v = w * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(w * (p - labels) * x).sum() + 0.05 * a, (w * (p - labels)).sum()])
        h = np.array([[(v * x * x).sum() + 0.05, (v * x).sum()], [(v * x).sum(), v.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return a / spread, b - a * mean / spread


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        margins = np.array([text_margin(t, self.weights) for t in texts], "f8")
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text"
) -> Model:
    """Learns from the labels (doc_id, toxic) for which ``learn``, a condition on doc_id, holds."""
    with scratch(docs.sparkSession):
        return _fit(docs, labels, learn, id_column, text_column)


def _fit(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str, text_column: str) -> Model:
    usable = labels.filter(F.col("toxic").isNotNull() & learn).select(
        "doc_id", (F.col("toxic") != 0).cast("int").alias("toxic")
    )
    share = usable.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    by_hash = [
        usable.filter(F.col("toxic") == c).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(MAX_LABELLED)
        for c in (0, 1)
    ]
    sample = materialise(by_hash[0].unionByName(by_hash[1]))
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    # At most 2 * MAX_LABELLED ids; the limit only tells where many texts share a labelled id.
    met = picked.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")
    texts = met.limit(4 * MAX_LABELLED).repartition(1)

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for piece in slices(batch, "text") for r in piece.to_pylist()]
        rows.sort(key=lambda r: (str(r["doc_id"]), r["text"] or "", r["toxic"]))
        toxic = np.array([r["toxic"] for r in rows], "i8")
        held = _held_back(toxic)
        weights, slope, offset = np.zeros(1 << BUCKET_BITS, "f4"), 0.0, _log_odds(share)
        if 0 < toxic[~held].sum() < (~held).sum():
            weights = train([r["text"] or "" for r, h in zip(rows, held) if not h], toxic[~held])
            if not 0 < toxic[held].sum() < held.sum():
                held = np.ones(len(rows), bool)
            margins = np.array([text_margin(r["text"] or "", weights) for r, h in zip(rows, held) if h])
            slope, offset = calibrate(margins, toxic[held], share)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "slope": [slope], "offset": [offset]})

    found = map_arrow(texts, learn_all, "weights binary, slope double, offset double").first()
    if found is None:  # no labelled text at all
        return Model(np.zeros(1 << BUCKET_BITS, "f4"), 0.0, _log_odds(share))
    return Model(np.frombuffer(found.weights, "f4"), found.slope, found.offset)


def _log_odds(share: float) -> float:
    return float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))


def _held_back(toxic: np.ndarray) -> np.ndarray:
    """One in ``CALIBRATE_EVERY`` texts of either class."""
    held = np.zeros(len(toxic), bool)
    for c in (0, 1):
        held[np.flatnonzero(toxic == c)[CALIBRATE_EVERY - 1 :: CALIBRATE_EVERY]] = True
    return held


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Struct ``row`` with the columns of ``docs``, and ``score``."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores([t or "" for t in texts]))

    return docs.select(row_struct(docs), scored(F.col(text_column)).alias("score"))


def learned_fold(column: str = "doc_id") -> Column:
    """Ids whose labels may be learned from: all but a quarter that is held out."""
    return id_crc32(column) % 4 != 2
