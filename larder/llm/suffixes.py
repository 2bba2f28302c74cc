"""Suffix-array dedup with a sparse suffix array: passages of many words that an earlier dossier holds too.

Of every window of ``words`` words one gram is the minimiser, the one with the smallest hash; only the suffixes that begin at
minimisers are retained, about one in twenty. Equal windows have their minimiser at the same place. So:

1. Each block sends the hashes of its minimisers once; those that stand in one dossier only are dropped.
2. Of the others each block sends the suffix (``words`` words) and what precedes it in the window, once per distinct content with the
   smallest id. Slices sort the suffixes and compare neighbours: the longest common prefix says how far a match can reach to
   the right. Matches are extended to the left over all windows that this leaves open, and every window gets the
   smallest id it stands under.
3. Blocks turn the answers into spans of their dossiers.

A minimiser that stands in very many dossiers (a passage in a third of them, each time after other words) would fill one slice
with one row per dossier. Its windows are sent by themselves instead and dealt by their own hashes, so only equal windows
meet, once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.blocks import SMALL_BLOCK_BYTES, Blocks, combine, cut, gather, ids_of, lookup, messages, pack, slice_bits, unpack
from larder.llm.substrings import first_ids
from larder.llm.words import Words, covered, distinct, mix, powers

WORDS = 50
GRAM = 10
#: Dossiers from which on the windows of a minimiser are dealt by themselves.
HOT_DOSSIERS = 2048
#: Suffixes of a slice.
SLICE_SUFFIXES = 1 << 15
_BASE = 0xD1342543DE82EF95

SPANS = "array<struct<start: int, size: int, first_recipe_id: long>>"
RESULT = f"recipe_id long, n_words long, n_repeated long, spans {SPANS}, kept_text string"


def repeated_passages(
    dossiers: DataFrame, words: int = WORDS, gram: int = GRAM, hot: int = HOT_DOSSIERS, block_bytes: int | None = None
) -> DataFrame:
    """Find the passages of at least ``words`` words that a dossier with a smaller ``recipe_id`` holds too.

    ``dossiers``: ``recipe_id`` and ``text``; other columns are ignored. Words are separated by blanks and compared unchanged.

    Returns one row per input row: ``recipe_id``, ``n_words``, ``n_repeated`` (words inside a repeated window of ``words`` words), ``spans``
    (runs of these: ``start``, ``size`` in words, ``first_recipe_id``: the smallest id that one of its windows stands under) and ``kept_text``: the text
    without the spans, null where there is none. A null, empty or shorter text has no spans. Rows of one id do not repeat each other; a
    missing id comes after all others.
    """
    return _repeated(Blocks(dossiers, block_bytes, least=SMALL_BLOCK_BYTES), words, gram, hot, RESULT)


def without_repeated_passages(
    dossiers: DataFrame, words: int = WORDS, gram: int = GRAM, hot: int = HOT_DOSSIERS, block_bytes: int | None = None
) -> DataFrame:
    """``dossiers`` with all their columns, ``text`` cut by the passages of :func:`repeated_passages`.

    A dossier of which nothing but blanks is left is dropped; null, empty and blank texts stay as they are.
    """
    columns = dossiers.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"])
    blocks = Blocks(dossiers, block_bytes, rest, SMALL_BLOCK_BYTES)
    carried = blocks.frame.schema["carried"].dataType.simpleString()
    found = _repeated(blocks, words, gram, hot, f"{RESULT}, text string, carried {carried}")
    kept = found.filter("kept_text is null or kept_text rlike '[^ \\\\x09-\\\\x0D]'")
    text = F.coalesce("kept_text", "text").alias("text")
    return kept.select(*[text if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in columns])


def _repeated(blocks: Blocks, words: int, gram: int, hot: int, schema: str) -> DataFrame:
    minimisers = max(1, blocks.bytes // 6 // ((words - gram + 2) // 2))
    bits = slice_bits(minimisers, slice_values=SLICE_SUFFIXES)
    shared = combine(blocks.send(partial(_anchors, words, gram, bits)), partial(_shared, hot))
    suffixes = blocks.receive(shared, partial(_suffixes, words, gram, bits), "slice int, block int, payload binary")
    answers = combine(suffixes, partial(_matches, words, gram, bits))
    return blocks.receive(answers, partial(_spans, words, gram, bits), schema)


def minimisers(texts: Words, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words at which minimisers begin, and the hashes of their grams."""
    windows = texts.window_starts(words)
    if not len(windows):
        return windows, np.zeros(0, dtype=np.uint64)
    at = np.arange(len(texts.hashes) - gram + 1)
    best = texts.window_hashes(at, gram)
    hashes, place, size = best, at, 1
    width = words - gram + 1
    while size < width:  # smallest of ever wider ranges; of equal ones the leftmost
        step = min(size, width - size)
        left = best[step:] < best[:-step] if step < len(best) else np.zeros(0, dtype=bool)
        n = len(left)
        best, place = np.where(left, best[step:], best[:n]), np.where(left, place[step:], place[:n])
        size += step
    chosen = distinct(place[windows])
    return chosen, hashes[chosen]


def _anchors(words: int, gram: int, bits: int, block: int, table: pa.Table) -> pa.Table:
    """Each minimiser of a block once, with the number of dossiers that hold it."""
    texts = Words(table["text"])
    at, hashes = minimisers(texts, words, gram)
    owner = ids_of(table)[texts.texts_of_words()[at]]
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, counts = np.unique(hashes[new], return_counts=True)
    return messages(block, ((s, pack(hashes[a:b], counts[a:b])) for s, a, b in cut(hashes, bits)))


def _shared(hot: int, slice_number: int, blocks: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The minimisers that more than one dossier holds, and whether very many do."""
    (hashes, counts), _, begins = gather(payloads, 2)
    distinct, which = np.unique(hashes, return_inverse=True)
    # ids may come again in another block only for rows that repeat an id; that sends a suffix in vain
    total = np.bincount(which, weights=counts.astype(np.float64), minlength=len(distinct))[which]
    for k, block in enumerate(blocks):
        part = slice(begins[k], begins[k + 1])
        more = total[part] > 1
        if more.any():
            yield block, pack(hashes[part][more], total[part][more] > hot)


class _Places:
    """The shared minimisers of a block, with the words around them."""

    def __init__(self, words: int, gram: int, table: pa.Table):
        self.texts = Words(table["text"])
        self.ids = ids_of(table)
        self.at, self.hashes = minimisers(self.texts, words, gram)
        self.words, self.before = words, words - gram
        owner = self.texts.texts_of_words()[self.at]
        self.owner = owner
        self.own = self.ids[owner]
        self.left = np.minimum(self.at - self.texts.first[owner], self.before)
        self.right = np.minimum(self.texts.first[owner + 1] - self.at, words)

    def keep(self, mask: np.ndarray) -> None:
        for name in ("at", "hashes", "owner", "own", "left", "right"):
            setattr(self, name, getattr(self, name)[mask])

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """32-bit codes of the words before and from each minimiser on; 0 where there is none."""
        steps = np.arange(-self.before, self.words)
        where = self.at[rows, None] + steps
        inside = (steps >= -self.left[rows, None]) & (steps < self.right[rows, None])
        codes = (self.texts.hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        return np.where(inside, codes[np.clip(where, 0, len(codes) - 1)], np.uint32(0))

    def content(self) -> np.ndarray:
        """One hash for what stands around each minimiser."""
        out = self.hashes.copy()
        for name, begin, size in (("left", self.at - self.left, self.left), ("right", self.at, self.right)):
            for n in np.unique(size):
                some = np.flatnonzero(size == n)
                if n:
                    order = np.argsort(begin[some], kind="stable")
                    part = some[order]
                    out[part] = mix(out[part] ^ self.texts.window_hashes(begin[part], int(n), 1))
            out = mix(out + np.uint64(len(name)) + size.astype(np.uint64))
        return out

    def windows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and first word of every window around each of these minimisers."""
        low, high = np.maximum(self.words - self.right[rows], 0), self.left[rows]  # words of the window before the minimiser
        sizes = np.maximum(high - low + 1, 0)
        which = np.repeat(np.arange(len(rows)), sizes)
        before = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]
        return rows[which], self.at[rows[which]] - before


def _known(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    (hashes, hot), _, _ = gather(answers, 2)
    order = np.argsort(hashes)
    return hashes[order], hot[order] > 0


def _suffixes(words: int, gram: int, bits: int, block: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
    places = _Places(words, gram, table)
    known, hot = _known(answers)
    place = lookup(places.hashes, known)
    places.keep(place >= 0)
    is_hot = hot[place[place >= 0]]
    cool, warm = np.flatnonzero(~is_hot), np.flatnonzero(is_hot)

    content = places.content()
    order = cool[np.lexsort((places.own[cool], content[cool], places.hashes[cool]))]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (places.hashes[order][1:] != places.hashes[order][:-1])
    order = order[new]
    hashes = places.hashes[order]

    def parts() -> Iterator[tuple[int, bytes]]:
        for s, a, b in cut(hashes, bits):
            rows = order[a:b]
            head = pack(hashes[a:b], content[rows], places.own[rows])
            yield s, len(head).to_bytes(8, "little") + head + places.codes(rows).tobytes()
        row, start = places.windows(warm)
        one, two = _window_hashes(places.texts, start, words)
        own = places.own[row]
        by = np.lexsort((own, two, one))
        one, two, own = one[by], two[by], own[by]
        first = np.ones(len(one), dtype=bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        one, two, own = one[first], two[first], own[first]
        for s, a, b in cut(one, bits):
            yield (1 << bits) | s, pack(one[a:b], two[a:b], own[a:b])

    return messages(block, parts())


def _window_hashes(texts: Words, start: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    distinct, which = np.unique(start, return_inverse=True)
    return texts.window_hashes(distinct, words)[which], texts.window_hashes(distinct, words, 1)[which]


def _matches(
    words: int, gram: int, bits: int, slice_number: int, blocks: list[int], payloads: list[bytes]
) -> Iterator[tuple[int, bytes]]:
    """Answers of a slice: kind 0 for suffixes (content, words before it, smallest id), kind 1 for windows."""
    if slice_number >> bits:
        for block, payload in first_ids(slice_number, blocks, payloads):
            yield block, b"\x01" + payload
        return
    before, width = words - gram, 2 * words - gram
    heads, bodies = [], []
    for payload in payloads:
        size = 8 + int.from_bytes(payload[:8], "little")
        heads.append(payload[8:size])
        bodies.append(np.frombuffer(payload, dtype=np.uint32, offset=size).reshape(-1, width))
    (anchors, content, ids), _, begins = gather(heads, 3)
    codes, ids = np.concatenate(bodies), ids.astype(np.int64)

    # sort the suffixes and compare neighbours
    right = codes[:, before:]
    key = np.concatenate([anchors.astype(">u8").view(np.uint8).reshape(-1, 8), right.astype(">u4").view(np.uint8).reshape(len(codes), -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    ordered = right[order]
    same = (ordered[1:] == ordered[:-1]) & (ordered[1:] != 0)
    prefix = np.cumprod(same, axis=1, dtype=np.uint8).sum(axis=1) * (anchors[order][1:] == anchors[order][:-1])
    reach = np.zeros(len(codes), dtype=np.int64)
    reach[order[1:]] = prefix
    reach[order[:-1]] = np.maximum(reach[order[:-1]], prefix)

    # extend to the left: all windows that end within reach
    has_left = (codes[:, :before] != 0).sum(axis=1)
    low, high = np.maximum(words - reach, 0), np.minimum(has_left, before)
    sizes = np.where(reach >= gram, np.maximum(high - low + 1, 0), 0)
    row = np.repeat(np.arange(len(codes)), sizes)
    left = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[row]
    hashes = np.empty(len(row), dtype=np.uint64)
    up, down = powers(_BASE, width + 1)
    ends = np.cumsum(sizes)
    for a in range(0, len(codes), 8192):
        part = slice(ends[a - 1] if a else 0, ends[min(a + 8192, len(codes)) - 1])
        sums = np.zeros((len(codes[a : a + 8192]), width + 1), dtype=np.uint64)
        np.cumsum(mix(codes[a : a + 8192].astype(np.uint64)) * up[:width], axis=1, out=sums[:, 1:])
        r, begin = row[part] - a, before - left[part]
        hashes[part] = (sums[r, begin + words] - sums[r, begin]) * down[begin]
    hashes = mix(mix(hashes) ^ anchors[row] ^ (left.astype(np.uint64) << np.uint64(8)))
    by = np.lexsort((ids[row], hashes))
    new = np.ones(len(by), dtype=bool)
    new[1:] = hashes[by][1:] != hashes[by][:-1]
    smallest = np.empty(len(by), dtype=np.int64)
    smallest[by] = ids[row][by][np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else 0
    less = smallest < ids[row]
    at = np.searchsorted(row, begins)
    for k, block in enumerate(blocks):
        some = np.flatnonzero(less[at[k] : at[k + 1]]) + at[k]
        if len(some):
            some = some[np.argsort(content[row[some]], kind="stable")]
            yield block, b"\x00" + pack(content[row[some]], left[some], smallest[some])


def _nullable(rows: pa.ChunkedArray) -> pa.StructArray:
    """The same structs with fields that may be null, as Spark declares them."""
    rows = rows.combine_chunks()
    return pa.StructArray.from_arrays(rows.flatten(), fields=[f.with_nullable(True) for f in rows.type])


def _spans(words: int, gram: int, bits: int, block: int, table: pa.Table, answers: list[bytes]) -> pa.Table:
    places = _Places(words, gram, table)
    texts, ids = places.texts, places.ids
    first = np.full(len(texts.hashes) + 1, np.iinfo(np.int64).max)  # smallest id of the window at each word

    # ids within the block: equal content around a minimiser, whatever other blocks hold
    content = places.content()
    distinct, which = np.unique(content, return_inverse=True)
    smallest = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, places.own)
    row, start = places.windows(np.flatnonzero(smallest[which] < places.own))
    np.minimum.at(first, start, smallest[which][row])

    # suffixes: content and words before the minimiser
    (known, left, found), _, _ = gather([a[1:] for a in answers if a[0] == 0], 3)
    order = np.argsort(known, kind="stable")
    known, left, found = known[order], left[order].astype(np.int64), found[order].astype(np.int64)
    low, high = np.searchsorted(known, content, "left"), np.searchsorted(known, content, "right")
    row = np.repeat(np.arange(len(content)), high - low)
    entry = np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[row]
    np.minimum.at(first, places.at[row] - left[entry], found[entry])

    # windows dealt by themselves: those of other blocks, and those of this one
    windows = [unpack(a[1:]) for a in answers if a[0] == 1]
    at = texts.window_starts(words)
    own = ids[texts.texts_of_words()[at]]
    one = texts.window_hashes(at, words)
    order = np.argsort(one, kind="stable")
    same = one[order][1:] == one[order][:-1]
    some = lookup(one, np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *(w[0] for w in windows)]))) >= 0
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    some = np.flatnonzero(some)
    all_one = np.concatenate([one[some], *(w[0] for w in windows)])
    all_two = np.concatenate([texts.window_hashes(at[some], words, 1), *(w[1] for w in windows)])
    all_ids = np.concatenate([own[some], *(w[2].astype(np.int64) for w in windows)])
    order = np.lexsort((all_ids, all_two, all_one))
    new = np.ones(len(order), dtype=bool)
    a, b = all_one[order], all_two[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.empty(len(order), dtype=np.int64)
    least[order] = all_ids[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else 0
    first[at[some]] = np.minimum(first[at[some]], least[: len(some)])

    repeated = at[first[at] < own]
    gone = covered(repeated, words, len(texts.hashes))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    # two texts may touch: cut runs where a text begins
    cuts = texts.first[1:-1]
    inner = np.unique(cuts[(cuts > 0) & (cuts < len(gone))])
    inner = inner[gone[inner] & gone[inner - 1]] if len(inner) else inner
    begins, ends = np.sort(np.concatenate([begins, inner])), np.sort(np.concatenate([ends, inner]))
    source = np.minimum.reduceat(first[repeated], np.searchsorted(repeated, begins)) if len(begins) else np.zeros(0, dtype=np.int64)
    of = texts.texts_of_words()[begins] if len(begins) else begins
    at = np.searchsorted(of, np.arange(table.num_rows + 1))
    spans, kept, counts = [], [], []
    for k in range(table.num_rows):
        rows = range(at[k], at[k + 1])
        spans.append(
            [
                {"start": int(begins[r] - texts.first[k]), "size": int(ends[r] - begins[r]), "first_recipe_id": int(source[r])}
                for r in rows
            ]
        )
        counts.append(int(sum(ends[r] - begins[r] for r in rows)))
        if not rows:
            kept.append(None)
            continue
        parts, low = [], texts.offsets[k]
        for r in rows:
            parts.append(texts.data[low : texts.starts[begins[r]]].tobytes())
            low = texts.ends[ends[r] - 1]
        parts.append(texts.data[low : texts.offsets[k + 1]].tobytes())
        kept.append(b"".join(parts).decode())
    carried = {"text": table["text"], "carried": _nullable(table["carried"])} if "carried" in table.column_names else {}
    span = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("first_recipe_id", pa.int64())])
    return pa.table(
        {
            "recipe_id": table["recipe_id"],
            "n_words": pa.array(texts.counts, pa.int64()),
            "n_repeated": pa.array(counts, pa.int64()),
            "spans": pa.array(spans, pa.list_(span)),
            "kept_text": pa.array(kept, pa.string()),
            **carried,
        }
    )
