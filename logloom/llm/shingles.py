"""Word and shingle hashes of many texts at once, in numpy.

Words are the runs between ASCII white space; A-Z count as a-z. A word's hash is the sum, modulo 2**64, of a random value of
each byte times a random odd number of its place in the word (multilinear hashing: no structure in the words makes two of
them meet, unlike with a polynomial); a shingle's hash is the like sum of its words' hashes. Work goes in slices of about
SLICE bytes, cut between documents, or between words inside a longer document (a word that is longer than a slice is held
whole), so memory does not follow text length but for 8 bytes a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = [int(x) | 1 for x in _rng.integers(2**40, 2**62, 64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers_of(places: np.ndarray) -> np.ndarray:
    return mix(places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1B873593CC9E2D51)) | np.uint64(1)


_NUMBERS = _numbers_of(np.arange(4096))


def byte_numbers(places: np.ndarray) -> np.ndarray:
    """The random odd number of each byte's place in its word."""
    return _NUMBERS[places] if not len(places) or places.max() < len(_NUMBERS) else _numbers_of(places)


def _words(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of buf; no word reaches over a cut."""
    n = len(buf)
    solid = ~_BLANK[buf]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    if len(cuts):
        cuts = cuts[cuts < n]
        begins[cuts] = solid[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    places = np.arange(n - starts[0]) - np.repeat(starts - starts[0], np.diff(np.append(starts, n)))
    # blanks add nothing, so a word's sum may run to the next word
    values = np.where(solid[starts[0] :], _VALUE[buf[starts[0] :]], np.uint64(0)) * byte_numbers(places)
    return mix(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Of one text of any length."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            while not len(blanks) and end < len(data):  # a word longer than a slice
                end = min(len(data), end + SLICE)
                blanks = np.flatnonzero(_BLANK[data[at:end]])
            if end < len(data):
                end = at + int(blanks[-1]) + 1
        out.append(_words(data[at:end], np.empty(0, np.int64))[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _combine(words: np.ndarray, k: int) -> np.ndarray:
    total = words[: len(words) - k + 1] * np.uint64(_PLACE[0])
    for j in range(1, k):
        total = total + words[j : len(words) - k + 1 + j] * np.uint64(_PLACE[j])
    return mix(total)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles, in order and with repeats; the whole sequence as one if it is shorter."""
    if len(words) >= k:
        return _combine(words, k)
    if not len(words):
        return words
    return _combine(words, len(words)) ^ np.uint64(0x9E3779B97F4A7C15 * len(words) % 2**64)


def batches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of every text, in order."""
    at = 0
    while at < len(texts):
        size, end = len(texts[at]), at + 1
        while end < len(texts) and size + len(texts[end]) <= SLICE:
            size += len(texts[end])
            end += 1
        if end == at + 1:
            yield at, word_hashes(np.frombuffer(texts[at], np.uint8))
        else:
            ends = np.cumsum([len(t) for t in texts[at:end]])
            hashes, starts = _words(np.frombuffer(b"".join(texts[at:end]), np.uint8), ends[:-1])
            upto = np.searchsorted(starts, ends)
            for i in range(at, end):
                yield i, hashes[upto[i - at - 1] if i > at else 0 : upto[i - at]]
        at = end


def distinct(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of every text."""
    for _, words in batches(texts):
        yield np.unique(shingles(words, k))


def column_sets(column, k: int, rows: int = 512) -> Iterator[np.ndarray]:
    """distinct() of an Arrow string column, so many rows at a time."""
    for i in range(0, len(column), rows):
        yield from distinct(encoded(column.slice(i, rows)), k)


def encoded(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def first_words(text: str, k: int) -> int:
    """64 signed bits of the first k words in lower case, by a cryptographic hash: of a text with one shingle, they are all there is to know."""
    words = text.encode().lower().split(None, k)[:k]  # of bytes: ASCII letters and white space only
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)
