"""Words and word shingles of a whole Arrow column at once, as numpy arrays.

Word bounds and hashes come from a few passes over the bytes of many texts, so
no Python code runs per word.  Texts are worked through in chunks of bounded
bytes; a single text longer than that makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Numbers of 8 bytes are made for every byte of a chunk, several at a time: some 60 MB at the peak.
CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEEDED = np.random.default_rng(20240607)
_BYTE = _SEEDED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _SEEDED.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, label: str, n: int) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64; kept while texts of about that length come."""
    made = _powers.get(label)
    if made is None or len(made) < n:
        made = np.full(max(n, CHUNK_BYTES), base, dtype=np.uint64)
        made[0] = 1
        made = np.cumprod(made, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[label] = made
    return made[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of ``n`` texts that lie one behind the other in ``data``."""

    n: int
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # n + 1 places of texts in data
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # n + 1 places of texts in the words

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for equal words anywhere."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each span of bytes."""
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, "base", len(data)), out=total[1:])
    return mixed((total[end] - total[start]) * _power(_BASE_INVERSE, "inverse", len(data))[start])


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(number of texts before, words) for pieces of a string column; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        low = offsets[at]
        yield at, split_words(data[low : offsets[to]], offsets[at : to + 1] - low)
        at = to


def split_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    n = len(bounds) - 1
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(n, data, bounds, none, none, np.zeros(n + 1, dtype=np.int64))
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    heads = bounds[:-1][np.diff(bounds) > 0]  # a word never goes on in the next text
    begins[heads] = inside[heads]
    tails = bounds[1:][np.diff(bounds) > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    return Words(n, data, bounds, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles as (text, 48-bit hash, times in the text), sorted by text and hash.

    A text of one to ``size - 1`` words has one shingle, of all its words.
    """
    hashed = words.hashes()
    if not len(hashed):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    text = np.repeat(np.arange(words.n), words.count)
    last = np.repeat(words.first[1:], words.count)
    at = np.arange(len(hashed))
    use = (at + size <= last) | ((at == words.first[text]) & (at + size > last))
    at, text, last = at[use], text[use], last[use]
    joined = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        there = at + k < last
        joined += np.where(there, hashed[np.minimum(at + k, len(hashed) - 1)] * _PLACE[k], np.uint64(0))
    key = mixed(joined) >> np.uint64(16)
    order = np.lexsort((key, text)) if words.n > 1 << 15 else None
    if order is None:
        packed = np.sort((text.astype(np.uint64) << np.uint64(48)) | key)
        text, key = (packed >> np.uint64(48)).astype(np.int64), (packed & np.uint64((1 << 48) - 1)).astype(np.int64)
    else:
        text, key = text[order], key[order].astype(np.int64)
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    place = np.flatnonzero(new)
    return text[place], key[place], np.diff(np.append(place, len(key)))
