"""Vectorised word and shingle hashes over whole Arrow text columns.

A word is a maximal run of characters outside space and tab to carriage return. All of these are
single bytes in UTF-8, so words are found on the encoded buffer of a batch without decoding it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
#: Blocks of eight bytes hashed at once.
_STRETCH = 1 << 16


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest n bytes of a block of eight.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class WordHasher:
    """Word hashes of byte buffers: blocks of eight bytes are mixed with their place in the word, then added.

    A sum of byte codes times powers of a base modulo 2^64 would be cheaper, but whatever the base it gives equal
    hashes to some different words of 1,024 letters. A-Z count as a-z when ``lower``.
    """

    def __init__(self, lower: bool = True):
        self._lower = lower

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of ``data`` (uint8); words never cross a value in ``bounds``."""
        if len(data) == 0:
            empty = np.zeros(0, dtype=np.int64)
            return empty, empty, np.zeros(0, dtype=np.uint64)
        word = ~_IS_SPACE[data]
        before = np.empty(len(data), dtype=bool)
        before[0] = False
        before[1:] = word[:-1]
        before[bounds[(bounds >= 0) & (bounds < len(data))]] = False
        starts = np.flatnonzero(word & ~before)
        after = np.empty(len(data), dtype=bool)
        after[-1] = True
        after[:-1] = ~word[1:]
        cuts = bounds[(bounds > 0) & (bounds <= len(data))] - 1
        after[cuts] = True
        ends = np.flatnonzero(word & after) + 1
        return starts, ends, self.spans(data, starts, ends)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the spans; a bounded number of blocks at a time, also inside one long span."""
        lengths = ends - starts
        hashes = np.zeros(len(starts), dtype=np.uint64)
        held = np.zeros(len(data) + 8, dtype=np.uint8)
        held[: len(data)] = _LOWER[data] if self._lower else data
        blocks = np.ndarray(len(data) + 1, dtype="<u8", buffer=held, strides=(1,))
        counts = np.maximum(1, (lengths + 7) >> 3)
        last = np.cumsum(counts)
        first = last - counts
        for low in range(0, int(last[-1]) if len(last) else 0, _STRETCH):
            high = min(low + _STRETCH, int(last[-1]))
            a, b = np.searchsorted(first, low, "right") - 1, np.searchsorted(first, high, "left")
            begins = np.maximum(first[a:b], low)
            shares = np.minimum(last[a:b], high) - begins
            place = np.arange(low, high) - np.repeat(first[a:b], shares)
            at = np.repeat(starts[a:b], shares) + 8 * place
            left = np.minimum(np.repeat(ends[a:b], shares) - at, 8)
            block = (blocks[at] & _HEAD[left]) + place.astype(np.uint64) * np.uint64(_BASE)
            hashes[a:b] += np.add.reduceat(mixed(block), begins - low)
        return mixed(hashes ^ (lengths.astype(np.uint64) * np.uint64(_STEP)))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    base = offsets[0] if len(offsets) else 0
    return data[base : offsets[-1]] if len(offsets) else data, offsets - base


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, in order; one hash of all words if there are fewer, none if none."""
    count = len(words)
    if count == 0:
        return words
    width = min(size, count)
    total, held = words, 1
    for bit in f"{width:b}"[1:]:  # twice as many words, and one more
        total = total[: len(total) - held] * np.uint64(pow(_BASE, held, 1 << 64)) + total[held:]
        held *= 2
        if bit == "1":
            total = total[:-1] * np.uint64(_BASE) + words[held:]
            held += 1
    return mixed(total ^ np.uint64((width * _STEP) & _MASK))
