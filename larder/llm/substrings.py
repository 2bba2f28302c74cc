"""Substring dedup: a count-min sketch of all word windows decides which of them are grouped exactly.

Each block counts its windows into a sparse sketch: two rows of cells, of each row only the cells that
it hit. Slices of the rows merge the blocks' sketches. The width grows with the corpus (eight cells for
each window), so the share of windows that are overestimated stays the same at every size. A window
whose smaller estimate is below two stands nowhere else; estimates are never too small, so no repeated
window is lost. Only the rest is grouped exactly, by 96-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm.blocks import Blocks, combine, cut, gather, ids_of, lookup, messages, pack, slice_bits
from larder.llm.words import Words, covered, mix

ROWS = 2
CELLS_PER_WINDOW = 8
_ROW_SEEDS = np.array([0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47], dtype=np.uint64)

RESULT = "recipe_id long, n_words long, n_removed long, kept_text string"


def drop_repeated_passages(dossiers: DataFrame, words: int = 13, block_bytes: int | None = None) -> DataFrame:
    """Remove from each dossier what an earlier dossier has already said.

    ``dossiers``: ``recipe_id`` and ``text``; other columns are ignored. Words are separated by blanks
    (space, tab to carriage return) and compared unchanged. A word goes if it lies in a window of ``words``
    words that also stands in a dossier with a smaller ``recipe_id``. All windows are judged on the texts as given.

    Returns one row per input row: ``recipe_id``, ``n_words``, ``n_removed`` and ``kept_text`` (the words that
    stay, joined by one space). A null or empty text, or one of fewer than ``words`` words, loses nothing. Rows that repeat an id
    do not count as smaller than each other. A missing id comes after all others. An empty table gives an empty one.
    """
    blocks = Blocks(dossiers, block_bytes)
    windows = max(1, blocks.bytes // 6)
    width = max(10, int(np.ceil(np.log2(CELLS_PER_WINDOW * windows))))
    bits = min(width, slice_bits(windows))
    heavy = combine(blocks.send(partial(_sketch, words, width, bits)), _merge)
    exact = blocks.receive(heavy, partial(_candidates, words, width, bits), "slice int, block int, payload binary")
    first = combine(exact, first_ids)
    return blocks.receive(first, partial(_keep, words), RESULT)


def _second(texts: Words, at: np.ndarray, words: int) -> np.ndarray:
    """32 more bits for each window."""
    return texts.window_hashes(at, words, 1) >> np.uint64(32)


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix(hashes ^ _ROW_SEEDS[row]) >> np.uint64(64 - width)


def _sketch(words: int, width: int, bits: int, block: int, table: pa.Table) -> pa.Table:
    texts = Words(table["text"])
    hashes = texts.window_hashes(texts.window_starts(words), words)

    def parts() -> Iterator[tuple[int, bytes]]:
        for row in range(ROWS):
            cells, counts = np.unique(_cells(hashes, row, width), return_counts=True)
            for s, low, high in cut(cells, bits, width):
                yield (row << bits) | s, pack(cells[low:high], counts[low:high])

    return messages(block, parts())


def _merge(slice_number: int, blocks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Cells that count two windows or more over all blocks, for each block that hit them."""
    (cells, counts), _, begins = gather(payloads, 2)
    order = np.argsort(cells, kind="stable")
    new = np.ones(len(cells), dtype=bool)
    new[1:] = cells[order][1:] != cells[order][:-1]
    total = np.empty(len(cells), dtype=np.uint64)
    total[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1] if len(cells) else 0
    row = np.full(1, slice_number, dtype=np.uint64)
    for k, block in enumerate(blocks):
        part = slice(begins[k], begins[k + 1])
        found = cells[part][total[part] > 1]
        if len(found):
            yield block, pack(np.concatenate([row * 0, found]), np.concatenate([row, found * 0]))


def _candidates(words: int, width: int, bits: int, block: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
    """The windows of a block that both rows estimate to stand twice or more, with their smallest id."""
    heavy: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    for payload in answers:
        (cells, slices), _, _ = gather([payload], 2)
        heavy[int(slices[0]) >> bits].append(cells[1:])
    texts = Words(table["text"])
    at = texts.window_starts(words)
    hashes = texts.window_hashes(at, words)
    keep = np.ones(len(at), dtype=bool)
    for row in range(ROWS):
        known = np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *heavy[row]]))
        keep[keep] = lookup(_cells(hashes[keep], row, width), known) >= 0
    at, one = at[keep], hashes[keep]
    two = _second(texts, at, words)
    ids = ids_of(table)[texts.texts_of_words()[at]]
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    one, two, ids = one[new], two[new], ids[new]
    return messages(block, ((s, pack(one[a:b], two[a:b], ids[a:b])) for s, a, b in cut(one, bits)))


def first_ids(slice_number: int, blocks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Windows that stand in another block under a smaller id, with the smallest id of all."""
    (one, two, ids), _, begins = gather(payloads, 3)
    ids = ids.astype(np.int64)
    order = np.lexsort((ids, two, one))
    new = np.ones(len(one), dtype=bool)
    a, b = one[order], two[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = np.empty(len(one), dtype=np.int64)
    smallest[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(one) else 0
    for k, block in enumerate(blocks):
        part = slice(begins[k], begins[k + 1])
        less = smallest[part] < ids[part]
        if less.any():
            yield block, pack(one[part][less], two[part][less], smallest[part][less])


def _keep(words: int, block: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
    texts = Words(table["text"])
    at = texts.window_starts(words)
    one = texts.window_hashes(at, words)
    ids = ids_of(table)
    own = ids[texts.texts_of_words()[at]]

    # smallest id within the block; the second hash is only needed where the first is shared
    order = np.argsort(one, kind="stable")
    same = one[order][1:] == one[order][:-1]
    twins = np.zeros(len(at), dtype=bool)
    twins[order[1:][same]] = True
    twins[order[:-1][same]] = True
    smallest = own.copy()
    some = np.flatnonzero(twins)
    two = _second(texts, at[some], words)
    by = np.lexsort((own[some], two, one[some]))
    new = np.ones(len(some), dtype=bool)
    a, b = one[some][by], two[by]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    if len(some):
        smallest[some[by]] = own[some][by][np.flatnonzero(new)][np.cumsum(new) - 1]

    (known, second, first), _, _ = gather(answers, 3)
    order = np.lexsort((second, known))
    known, second, first = known[order], second[order], first[order].astype(np.int64)
    place = lookup(one, known)
    hit = np.flatnonzero(place >= 0)
    two = _second(texts, at[hit], words)
    place = place[hit]
    for _ in range(len(known)):  # first hashes that two windows share stand side by side
        wrong = second[place] != two
        more = wrong & (place + 1 < len(known))
        more[more] = known[place[more] + 1] == one[hit[more]]
        if not more.any():
            break
        place = place + more
    right = second[place] == two if len(hit) else np.zeros(0, dtype=bool)
    smallest[hit[right]] = np.minimum(smallest[hit[right]], first[place[right]])

    gone = covered(at[smallest < own], words, len(texts.hashes))
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), texts.first[:-1]) * (texts.counts > 0)
    kept = []
    for k in range(table.num_rows):
        parts = texts.data[texts.offsets[k] : texts.offsets[k + 1]].tobytes().split()
        if removed[k]:
            parts = itertools.compress(parts, (~gone[texts.first[k] : texts.first[k + 1]]).tolist())
        kept.append(b" ".join(parts).decode())
    return pa.table(
        {
            "recipe_id": table["recipe_id"],
            "n_words": pa.array(texts.counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_text": pa.array(kept, pa.string()),
        }
    )
