"""Words of whole Arrow batches as numpy arrays: boundaries and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_FOLDED = _RANDOM.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _RANDOM[ord("a") : ord("z") + 1]
_CACHE: dict[int, np.ndarray] = {}
#: Bytes of text worked on at once: temporaries stay in the processor's cache, memory does not follow the batch.
CHUNK = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    if base not in _CACHE or len(_CACHE[base]) < n:
        out = np.full(max(n, CHUNK) + 1, base, np.uint64)
        out[0] = 1
        _CACHE[base] = np.cumprod(out, dtype=np.uint64)
    return _CACHE[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words(NamedTuple):
    """Words of some documents: hash, first byte and end in `data`; document d has words at[d]:at[d + 1]."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def split(data: np.ndarray, offsets: np.ndarray, fold: bool) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each document, A-Z as a-z for the hash if fold."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    b, at = data[lo:hi], offsets - lo
    if not len(b):
        none = np.zeros(0, np.int64)
        return Words(b, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    word = ~_WS[b]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = at[:-1][at[:-1] < len(b)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = at[1:][at[1:] > 0] - 1
    last[ends] = word[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _RANDOM)[b] * powers(_BASE, len(b)), out=sums[1:])
    h = mix((sums[end] - sums[start]) * powers(_INV, len(b) + 1)[start])
    return Words(b, h, start, end, np.searchsorted(start, at))


def chunks(texts: pa.Array, fold: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) over a batch, about CHUNK bytes at a time, whole documents only."""
    data, offsets = buffers(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        yield i, j, split(data, offsets[i : j + 1], fold)
        i = j


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words of each document and the documents' bounds in them; documents with fewer words have none."""
    n = len(w.hash)
    count = np.maximum(np.diff(w.at) - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.zeros(0, np.uint64), bounds
    acc = w.hash[: n - k + 1].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + w.hash[j : n - k + 1 + j]
    pick = np.repeat(w.at[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    return mix(acc[pick]), bounds
