"""Words of many texts at once, as 64-bit fingerprints.

Everything works on the UTF-8 bytes of an Arrow text column, so a batch is cut into words with a few
vector operations and no Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space is 0x20 and 0x09 to 0x0D; all other bytes belong to words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, lower-case letters and everything beyond ASCII belong to words.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < size:
        held = np.full(max(size, SLAB_BYTES + 1), base, np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        _powers[name] = held
    return held[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def pieces(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` of text at most; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more entry than texts)."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all words, and the number of the first word of each text (one more entry).

    ``inside`` says for each byte value whether it belongs to a word; no word crosses two texts.
    """
    member = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each word, the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLAB_BYTES, "right")))
            low, high = int(starts[a]), int(ends[b - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(
                (data[low:high].astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, high - low),
                out=sums[1:],
            )
            s, e = starts[a:b] - low, ends[a:b] - low
            value = (sums[e] - sums[s]) * _power("down", inverse, high - low + 1)[s]
            out[a:b] = mix(value + (e - s).astype(np.uint64) * _MIX)
            a = b
    return out


def prints_of(column: pa.Array, inside: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a text column, and the number of the first word of each text."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    starts, ends, first = find_words(data, offsets, inside)
    return word_prints(data, starts, ends), first


def runs_print(words: np.ndarray, length: int) -> np.ndarray:
    """Fingerprint of each ``length`` consecutive words; shorter input gives none."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = (out + words[k : k + n]) * np.uint64(_BASE)
            out ^= out >> np.uint64(29)
        return mix(out)
