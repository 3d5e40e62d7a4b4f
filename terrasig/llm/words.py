"""Vectorised word and shingle hashing over an Arrow batch of texts (helpers used inside tasks).

A batch is hashed as one array of bytes, so the cost per document is a few numpy passes over its bytes. Words are
maximal runs of bytes outside a separator set, A-Z lower-cased. A null text has no words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: `[^\x20\x09-\x0D]+`, the words between white space.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_SPREAD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each; kept by the worker process."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (strings or binary) end to end, and the offset of each text (one more than texts); null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offset of each text's first word (one more than texts)."""
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~separators[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), ((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n]).cumsum(dtype=np.uint64)])
    hashes = mix((total[end] - total[at]) * down[at] + (end - at).astype(np.uint64) * _SPREAD[0])
    return hashes, np.searchsorted(at, offsets)


def shingle_hashes(texts: pa.Array, width: int = 5, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of `width` words in order, with the offset of each text's first; a text of fewer words,
    but not none, has its whole word sequence as the only one."""
    words, at = word_hashes(texts, separators)
    counts = np.diff(at)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    starts = np.concatenate([np.zeros(1, np.int64), sizes.cumsum()])
    total = int(starts[-1])
    place = np.arange(total) + np.repeat(at[:-1] - starts[:-1], sizes)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    short = np.repeat(counts, sizes) < width
    left = np.repeat(counts, sizes)
    for j in range(width):
        part = mix(padded[place + j] + _SPREAD[j % 5] + np.uint64(j // 5))
        if short.any():
            part = np.where(short & (left <= j), np.uint64(0), part)
        out = out * np.uint64(_BASE) + part
    return mix(out + short.astype(np.uint64) * left.astype(np.uint64)), starts


def sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order."""
    hashes, at = shingle_hashes(texts, width)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


#: Words of letters, digits and non-ASCII bytes; everything else in ASCII separates.
SIGNS = np.zeros(256, bool)
SIGNS[:128] = True
SIGNS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

#: Ends of sentences: full stop, exclamation mark, question mark, line feed.
STOPS = np.zeros(256, bool)
STOPS[[46, 33, 63, 10]] = True


def stem_hashes(texts: pa.Array, stems: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every word: the hash of the word and of its first 4, 5 and 6 bytes (one row each; a shorter word's stem is the
    word itself), the byte where it starts; and the offset of each text's first word; and the texts' byte offsets."""
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        return np.zeros((1 + len(stems), 0), np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), offsets
    word = ~SIGNS[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    at, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), ((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n]).cumsum(dtype=np.uint64)])
    rows = [mix((total[end] - total[at]) * down[at] + _SPREAD[0])]
    for k in stems:
        cut = np.minimum(end, at + k)
        rows.append(mix((total[cut] - total[at]) * down[at] + np.uint64(k * int(_SPREAD[1]) & (1 << 64) - 1)))
    return np.stack(rows), at, np.searchsorted(at, offsets), offsets


def slices(batches, column: str, limit: int = 4 << 20):
    """Cut record batches so that a piece has at most `limit` bytes of text, or one row: what hashing holds stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
