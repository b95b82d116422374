"""Word shingles of whole texts as 64-bit hashes, vectorised over Arrow batches.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D`` after lower-casing
``A``-``Z``; a document's set holds its distinct shingles of ``width`` words, the whole sequence as
one shingle when it has fewer words, nothing when it has none (or is null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE_BYTES = 500_000  # texts are hashed in slices of about this many bytes; hashing holds some 40 bytes for each
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit integers (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), _BASE, np.uint64))), dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in ``data`` and, per text, the index range of its words.

    ``data`` are the bytes of consecutive texts, ``offsets`` (n + 1) where each begins.
    """
    n_texts = len(offsets) - 1
    if data.size == 0:
        return np.empty(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    x = _LOWER[data]
    gap = _SPACE[x]
    before = np.empty(len(x), bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[offsets[:-1][offsets[:-1] < len(x)]] = True
    starts = np.flatnonzero(~gap & before)
    bounds = np.searchsorted(starts, offsets)
    if starts.size == 0:
        return np.empty(0, np.uint64), bounds
    first = starts[0]
    rel = np.arange(first, len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    vals = (x[first:].astype(np.uint64) + np.uint64(1)) * _powers(int(rel.max()) + 1)[rel]
    vals[gap[first:]] = 0
    return mix64(np.add.reduceat(vals, starts - first)), bounds


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    keys = mix64(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j:j + n] * keys[j]
    return mix64(out)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``size`` bytes of text (a longer text stands alone)."""
    for batch in batches:
        weight = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            done = weight[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(weight, done + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of each text of a binary or string array."""
    texts = texts.cast(pa.large_binary())
    keys = mix64(np.arange(1, width + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    all_offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    nulls = texts.is_null().to_numpy(zero_copy_only=False)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(all_offsets, all_offsets[i] + _SLICE_BYTES, "right")) - 1)
        j = min(j, n)
        words, bounds = word_hashes(data[all_offsets[i]:all_offsets[j]], all_offsets[i:j + 1] - all_offsets[i])
        grams = _shingles(words, width) if len(words) >= width else np.empty(0, np.uint64)
        for k in range(j - i):
            a, b = bounds[k], bounds[k + 1]
            if nulls[i + k] or a == b:
                yield np.empty(0, np.uint64)
            elif b - a < width:
                yield mix64((words[a:b] * keys[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.unique(grams[a:b - width + 1])
        i = j
