"""Language identification by rank-order profiles.

A profile lists the ``PROFILE`` most frequent character 1- to 3-grams, of the words of a text
in lower case with marks at their ends. A document is of the language whose profile is
nearest: over the document's n-grams, the sum of how far each is out of place, or ``PROFILE``
where the language's profile lacks it.

The languages' n-grams are counted over the whole texts of all documents to learn from, summed
up in tasks first, exactly: an n-gram is the 64-bit number of its code points, so none collide.
Ties of counts go to the smaller number, ties of distance to the smaller name.

The score is 1 minus the distance as a share of the largest possible one. A text that is NULL
or has no letter is ``und`` with score 0, as is every text when there is nothing to learn from;
a NULL language is not learned.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_crc32, map_arrow, slices, texts_of
from tidemark.sources.tables import materialise

PROFILE = 300
#: The value set of a language column; profiles of so many are what tasks can hold.
MAX_LANGUAGES = 500
UNKNOWN = "und"
#: Characters that are counted at a time, and distinct n-grams that a task holds.
PART, HELD = 1 << 19, 1 << 20

COUNTS = "lang string, gram bigint, n bigint"
PREDICTED = "doc_id bigint, lang_pred string, score double"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them; made once per worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Letters as code point + 2, whatever else as 1, with a mark at both ends."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_letters()[points], points.astype("i8") + 2, 1)


def _grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams of a text part: numbers of 21 bits per character."""
    letter = codes != 1
    pair = codes[:-1] | codes[1:] << 21
    two = letter[:-1] | letter[1:]
    three = pair[:-1] | codes[2:] << 42
    return np.concatenate([codes[letter], pair[two], three[letter[1:-1]]])


def _parts(text: str) -> Iterator[str]:
    """Parts of at most twice ``PART`` characters, cut between words where there are any; a word
    longer than that counts as several."""
    start = 0
    while start < len(text):
        end = start + PART
        while end < min(len(text), start + 2 * PART) and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of texts, ascending, and how often each occurs."""
    found, pending, size = [], [], 0
    for text in texts:
        for part in _parts(text):
            grams = _grams(_codes(part))
            pending.append(grams)
            size += len(grams)
            if size > 8 * PART:
                found.append(np.unique(np.concatenate(pending), return_counts=True))
                pending, size = [], 0
    if size:
        found.append(np.unique(np.concatenate(pending), return_counts=True))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, "i8"), np.empty(0, "i8")
    return _summed(*[np.concatenate(x) for x in zip(*found)])


def _top(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most frequent n-grams in order of rank."""
    if len(n) > PROFILE:
        least = np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
        codes, n = codes[n >= least], n[n >= least]
    return codes[np.lexsort((codes, -n))][:PROFILE]


def learn_profiles(docs: DataFrame, learn: Column, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """lang, gram, place (from 0) of every language's profile, saved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, n = _summed(*[np.concatenate(x) for x in zip(*parts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"]
                )
            held.clear()

        for batch in batches:
            for piece in slices(batch, "text"):
                langs = piece.column("lang").to_pylist()
                texts = texts_of(piece.column("text"))
                for lang in set(langs):
                    codes, n = gram_counts([t for t, own in zip(texts, langs) if own == lang])
                    if len(codes):
                        held.setdefault(lang, []).append((codes, n))
                if sum(len(codes) for parts in held.values() for codes, _ in parts) > HELD:
                    yield from sums()
        yield from sums()

    known = docs.filter(F.col(lang_column).isNotNull() & learn).select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    )
    counts = map_arrow(known, count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return materialise(most_frequent(counts))


def most_frequent(counts: DataFrame) -> DataFrame:
    """lang, gram and place of the first ``PROFILE`` n-grams of each language. The filter is on the
    bare row number: each map task then forwards that many rows of a language at most."""
    by_rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= PROFILE)
    return ranked.select("lang", "gram", (F.col("rank") - 1).alias("place"))


def predict(docs: DataFrame, profiles: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document. The profiles, at most ``MAX_LANGUAGES`` times
    ``PROFILE`` rows, go along with the tasks."""
    if profiles.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    rows = profiles.collect()
    langs = sorted({r.lang for r in rows})
    known = np.unique(np.array([r.gram for r in rows], "i8"))
    places = np.full((len(known) + 1, len(langs)), PROFILE, "i2")
    for r in rows:
        places[np.searchsorted(known, r.gram), langs.index(r.lang)] = r.place

    def nearest(text: str) -> tuple[str, float]:
        grams = _top(*gram_counts([text]))
        if not len(grams) or not langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(known, grams)
        at = np.where(known[np.minimum(at, len(known) - 1)] == grams, at, len(known))
        theirs, own = places[at].astype("i4"), np.arange(len(grams))[:, None]
        apart = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - own)).sum(axis=0)
        best = int(apart.argmin())
        return langs[best], 1 - float(apart[best]) / (PROFILE * len(grams))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                found = [nearest(t) for t in texts_of(piece.column("text"))]
                names, scores = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return map_arrow(picked, label, PREDICTED)


def learned_fold(column: str = "doc_id") -> Column:
    """Ids that may be learned from: all but a fifth that is held out."""
    return id_crc32(column) % 5 != 0
