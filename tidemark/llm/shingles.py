"""Sets of word shingles as 64-bit numbers, whole texts at a time."""

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Bytes that are hashed at a time; texts are cut between words.
PART = 1 << 20
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is white space, and its number with A-Z as a-z."""
    space = np.zeros(256, bool)
    space[list(_SPACES)] = True
    values = mix(np.arange(1, 257, dtype="u8"))
    values[65:91] = values[97:123]
    return space, values


@cache
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    ups, downs = np.full(length, _BASE), np.full(length, _INVERSE)
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(raw: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(raw):
        end = start + PART
        while end < len(raw) and raw[end] not in _SPACES:
            end += 1
        yield raw[start:end]
        start = end


def word_hashes(text: str) -> np.ndarray:
    """One number per word, A-Z taken as a-z."""
    space, values = _tables()
    found = []
    for part in _parts(text.encode("utf-8", "surrogatepass")):
        raw = np.frombuffer(part, "u1")
        apart = space[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], apart, [True]])))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        size = 1 << max(12, (len(raw) - 1).bit_length())
        ups, downs = _powers(size)
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values[raw] * ups[: len(raw)])])
        found.append(mix((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype("u8")))
    return np.concatenate(found) if found else np.empty(0, "u8")


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingles of a text, ascending; with fewer words, all of them as one."""
    words = word_hashes(text)
    if not len(words):
        return words
    size = min(width, len(words))
    total = np.zeros(len(words) - size + 1, "u8")
    for i in range(size):
        total = mix(total + words[i : i + len(total)]) + np.uint64(i + 1)
    return np.unique(mix(total + np.uint64(size)))


def set_digest(hashes: np.ndarray) -> int:
    """A signed 64-bit number of a set, whatever the order it is given in."""
    total = np.concatenate([mix(hashes).sum(dtype="u8", keepdims=True), np.array([len(hashes)], "u8")])
    return int(mix(total[:1] + mix(total[1:])).view("i8")[0])
