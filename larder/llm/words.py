"""Words of many texts at once: positions and 64-bit hashes as numpy arrays.

Helpers for code that runs inside Spark tasks. A hash depends on the bytes of the word or words
alone, so every task, executor and run gives the same value. Texts are handled in segments cut
between words; temporary arrays stay small even when one text is very long.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 18
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_M64 = (1 << 64) - 1

BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words separated by blanks only.
PLAIN = ~BLANKS


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One odd value for each byte.
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(b: int) -> np.ndarray:
        steps = np.full(size, b, dtype=np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return powers(base), powers(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``size`` of them."""
    return _powers(base, max(1 << 16, 1 << (size - 1).bit_length()))


def spans(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span ``[start, end)`` from running sums, independent of where the span lies."""
    return (sums[ends] - sums[starts]) * inverse[starts]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each text (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a list of texts.

    ``starts``, ``ends``: byte positions; ``hashes``: one per word; ``first``: the number of the first
    word of each text, and of the end (one more than texts).
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, is_word: np.ndarray = PLAIN, lower: bool = False):
        self.data, self.offsets = utf8(texts)
        if lower:
            self.data = lower_ascii(self.data)
        starts, ends, hashes = [], [], []
        for low, high in self._segments(is_word):
            part = self.data[low:high]
            inside = is_word[part]
            breaks = self.offsets[np.searchsorted(self.offsets, low) : np.searchsorted(self.offsets, high)] - low
            before = np.zeros(len(part), dtype=bool)
            before[1:] = inside[:-1]
            before[breaks] = False
            start = np.flatnonzero(inside & ~before)
            after = np.zeros(len(part), dtype=bool)
            after[:-1] = inside[1:]
            after[breaks[breaks > 0] - 1] = False
            end = np.flatnonzero(inside & ~after) + 1
            up, down = powers(_BYTE_BASE, len(part) + 1)
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_BYTE_CODES[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix(spans(sums, down, start, end) + (end - start).astype(np.uint64)))
            starts.append(start + low)
            ends.append(end + low)
        none = np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([none, *starts])
        self.ends = np.concatenate([none, *ends])
        self.hashes = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def _segments(self, is_word: np.ndarray):
        """Cut the bytes between words, about SEGMENT_BYTES apart."""
        low, size = 0, len(self.data)
        while low < size:
            high = min(size, low + SEGMENT_BYTES)
            while high < size:
                blank = np.flatnonzero(~is_word[self.data[high : high + SEGMENT_BYTES]])
                if len(blank):
                    high += int(blank[0])
                    break
                high = min(size, high + SEGMENT_BYTES)
            yield low, high
            low = high

    def window_starts(self, size: int) -> np.ndarray:
        """Numbers of the words at which ``size`` words of one text begin."""
        inside = np.ones(len(self.hashes), dtype=bool)
        last = np.repeat(self.first[1:], self.counts)
        inside &= np.arange(len(inside)) + size <= last
        return np.flatnonzero(inside)

    def window_hashes(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        """Hash of the ``size`` words from each word of ``at`` on; ``which`` 0 or 1: two independent hashes."""
        base = _WORD_BASES[which]
        out = np.empty(len(at), dtype=np.uint64)
        step = 1 << 16  # windows in pieces: their sums need one power for each word of a piece
        cuts = np.searchsorted(at, np.arange(0, len(self.hashes) + step, step))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            begin, end = int(at[low]), int(at[high - 1]) + size
            up, down = powers(base, end - begin + 1)
            sums = np.zeros(end - begin + 1, dtype=np.uint64)
            np.cumsum(self.hashes[begin:end] * up[: end - begin], out=sums[1:])
            out[low:high] = mix(spans(sums, down, at[low:high] - begin, at[low:high] - begin + size))
        return out

    def texts_of_words(self) -> np.ndarray:
        """The number of its text for each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def distinct(values: np.ndarray) -> np.ndarray:
    """Each value once, sorted. Sorting is several times as fast as the hash table of ``numpy.unique`` on millions of hashes."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Of ``n`` places, those inside a window of ``size`` places from one of ``starts``."""
    change = np.zeros(n + size + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change)[:n] > 0
