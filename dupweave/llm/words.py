"""Word hashes of whole Arrow batches, with numpy over the text bytes: no Python loop over words.

A word is a maximal run of ASCII letters, digits, `_` and non-ASCII characters of the lower-cased text.
Its hash is a polynomial in its bytes modulo 2^64, mixed. Work goes in slices of whole texts of about
SLICE_BYTES, so memory follows the longest text (some 60 bytes a byte of text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

IS_WORD = np.zeros(256, bool)
IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"]] = True
IS_WORD[128:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def sorted_unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and UTF-8 bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run goes past the end of a text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[offsets] = True
    starts = mask & (cut[:-1] | ~np.concatenate(([False], mask[:-1])))
    ends = mask & (cut[1:] | ~np.concatenate((mask[1:], [False])))
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words_per_text(texts: pa.Array) -> np.ndarray:
    """The number of runs without white space of each text."""
    offsets, data = text_bytes(texts)
    counts = np.zeros(len(offsets) - 1, np.int64)
    for a, b in slices(offsets):
        own = offsets[a : b + 1] - offsets[a]
        starts, _ = runs(~IS_SPACE[data[offsets[a] : offsets[b]]], own)
        counts[a:b] = np.diff(np.searchsorted(starts, own))
    return counts


_powers = [np.zeros(0, U), np.zeros(0, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, U(base), U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """The words of some texts. bounds[i]:bounds[i+1] are text i's words; starts, ends: bytes in `data`."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes, or of one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_slices(texts: pa.Array, lower: bool = True) -> Iterator[Words]:
    """Words of the lower-cased texts; without `lower` only ASCII is lowered, for the hashes, and bytes keep their places."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets, data = text_bytes(texts)
    for a, b in slices(offsets):
        if lower:
            own, bytes_ = text_bytes(pc.utf8_lower(texts.slice(a, b - a).cast(pa.large_utf8())))
        else:
            own, bytes_ = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        starts, ends = runs(IS_WORD[bytes_], own)
        up, down = powers(len(bytes_) + 1)
        plain = bytes_ if lower else LOWERED[bytes_]
        sums = np.concatenate((np.zeros(1, U), np.cumsum((plain.astype(U) + U(1)) * up[:-1], dtype=U)))
        hashes = mix((sums[ends] - sums[starts]) * down[starts])
        yield Words(a, np.searchsorted(starts, own), hashes, starts, ends, own, bytes_)


GRAM = [U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of n words; a text with fewer words, but any, has one of all of them."""
    text = words.text_of_word()
    count = np.diff(words.bounds)
    h = words.hashes
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, U)
        for k in range(n):
            grams += h[k : len(h) - n + 1 + k] * GRAM[k]
        keep = text[: len(grams)] == text[n - 1 :]
        grams, at = mix(grams[keep]), text[: len(grams)][keep]
    else:
        grams, at = np.zeros(0, U), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([mix(np.sum(h[words.bounds[i] : words.bounds[i + 1]] * np.array(GRAM[: count[i]], U), dtype=U, keepdims=True) + U(count[i]))[0] for i in short], U)
        at, grams = np.concatenate((at, short)), np.concatenate((grams, extra))
    return at, grams


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted by text and hash: (bounds by text, hashes)."""
    at, grams = shingles(words, n)
    order = np.lexsort((grams, at))
    at, grams = at[order], grams[order]
    if len(grams):
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (grams[1:] != grams[:-1])))
        at, grams = at[new], grams[new]
    return np.searchsorted(at, np.arange(words.texts + 1)), grams
