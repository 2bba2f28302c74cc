"""Quality rules: counts over words and lines, and bands for how well a text compresses.

Text that says the same again compresses too well, noise too badly. Ratios are compressed to plain
size with zstandard, for the whole text and for chunks of it that overlap and reach to its end; which
ratios pass depends on the length of the text, because short texts always compress worse.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.words import PLAIN, Words, covered

CHUNK_BYTES = 4096
#: Chunks that begin in each chunk's length: a passage of nearly a chunk fills most of one, wherever it lies.
CHUNK_STEPS = 4
LEVEL = 3
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))


class Band(NamedTuple):
    """Limits for texts of at least ``min_bytes``: ratios of the whole text and of its full chunks."""

    min_bytes: int
    whole_low: float
    whole_high: float
    chunk_low: float
    chunk_high: float


#: Limits by length. Full chunks only exist from CHUNK_BYTES on. Base64 has 0.84 or more below 512 bytes, 0.79 below 1024, 0.76
#: below 4096 and 0.75 beyond; random printable characters have more.
BANDS = (
    Band(0, 0.0, 9.0, 0.0, 9.0),
    Band(256, 0.30, 0.83, 0.0, 9.0),
    Band(512, 0.30, 0.78, 0.0, 9.0),
    Band(1024, 0.27, 0.72, 0.0, 9.0),
    Band(4096, 0.22, 0.70, 0.22, 0.70),
    Band(16384, 0.18, 0.68, 0.20, 0.70),
)

RESULT = (
    "recipe_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "whole_ratio double, chunk_low double, chunk_high double, base_failed boolean, kept boolean"
)


def judge_texts(dossiers: DataFrame, bands: Sequence[Band] = BANDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Count words, symbols and repetitions of each dossier and decide whether to keep it.

    ``dossiers``: ``recipe_id`` and ``text``; other columns are ignored. Words are separated by blanks. ``word_chars``: code points in
    words; ``n_symbols``: characters of ``#*$%&|<>``; ``n_dup_lines``: lines with a word that equal an earlier line;
    ``n_repeat_words``: words in three-word windows that the text holds twice or more. ``base_failed``: fewer than 50 words, or more than half of
    them in ``n_repeat_words``. ``kept``: not ``base_failed``, and all ratios within the band of the text's length.

    Returns one row per input row. ``whole_ratio`` is null for an empty or null text; ``chunk_low`` and ``chunk_high``, the
    smallest and largest ratio of a full chunk, are null without one. Chunks begin every quarter of a chunk, and one ends with the text. Repeated rows are judged alike.
    """
    texts = dossiers.select(F.col("recipe_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(partial(_judge, tuple(sorted(bands)), chunk_bytes), RESULT)


def _sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, dtype=np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(texts: Words, size: int = 3) -> np.ndarray:
    """Words in windows of ``size`` words that stand twice or more in their text, per text."""
    at = texts.window_starts(size)
    owner = texts.texts_of_words()[at]
    hashes = texts.window_hashes(at, size)
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return _sums(covered(at[twice], size, len(texts.hashes)), texts.first)


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _judge(bands: tuple[Band, ...], chunk_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            yield _judged(bands, chunk_bytes, press, batch.slice(low, 500))


def _judged(bands: tuple[Band, ...], chunk_bytes: int, press, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = Words(batch.column("text"))
    data, offsets = texts.data, texts.offsets
    inside = PLAIN[data]
    words = texts.counts
    repeats = repeated_words(texts)
    lines, wholes, lows, highs, fine = [], [], [], [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        text = memoryview(data[a:b])
        lines.append(duplicate_lines(text.tobytes()))
        size = b - a
        whole = len(press.compress(text)) / size if size else None
        starts = {*range(0, size - chunk_bytes + 1, max(1, chunk_bytes // CHUNK_STEPS)), max(0, size - chunk_bytes)} if size >= chunk_bytes else ()
        parts = [len(press.compress(text[k : k + chunk_bytes])) / chunk_bytes for k in starts]
        chunk_low, chunk_high = (min(parts), max(parts)) if parts else (None, None)
        band = next((x for x in reversed(bands) if size >= x.min_bytes), None)
        fine.append(
            band is None
            or size == 0
            or band.whole_low <= whole <= band.whole_high
            and (not parts or band.chunk_low <= chunk_low and chunk_high <= band.chunk_high)
        )
        wholes.append(whole)
        lows.append(chunk_low)
        highs.append(chunk_high)
    failed = (words < 50) | (100 * repeats > 50 * words)
    columns = {
        "recipe_id": batch.column("recipe_id"),
        "n_words": pa.array(words, pa.int64()),
        "word_chars": pa.array(_sums(inside & ((data & 0xC0) != 0x80), offsets), pa.int64()),
        "n_symbols": pa.array(_sums(SYMBOLS[data], offsets), pa.int64()),
        "n_dup_lines": pa.array(lines, pa.int64()),
        "n_repeat_words": pa.array(repeats, pa.int64()),
        "whole_ratio": pa.array(wholes, pa.float64()),
        "chunk_low": pa.array(lows, pa.float64()),
        "chunk_high": pa.array(highs, pa.float64()),
        "base_failed": pa.array(failed),
        "kept": pa.array(~failed & np.array(fine, dtype=bool)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
