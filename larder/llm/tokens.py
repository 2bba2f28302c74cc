"""Token ids of many texts with a byte-level BPE tokenizer.

The tokenizer splits a text into words, numbers, runs of marks and blanks, and encodes each part on its own. Parts repeat, so
they are found with array operations, and each distinct part is encoded once per worker and kept in a bounded table. Texts with characters whose class differs between versions of
Unicode, and control characters, are left to the tokenizer itself.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

from larder.llm.words import mix, powers, spans

PIECE_CHARS = 1 << 20
MAX_PARTS = 2_000_000
_BASE = 0x9E3779B97F4A7C15
_LETTER, _NUMBER, _MARK, _BLANK, _UNSURE = range(1, 6)
_SURE = [*range(0x20, 0x7F), 0x09, 0x0A, 0x0D, *range(0xA1, 0x530), *range(0x2010, 0x2028)]
# What the tokenizer splits off after an apostrophe, in its order.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_CUT = re.compile(r"(?<=\S)\s")


def _classes() -> np.ndarray:
    table = np.full(0x2029, _UNSURE, dtype=np.uint8)
    for point in _SURE:
        kind = unicodedata.category(chr(point))
        table[point] = {"L": _LETTER, "N": _NUMBER, "Z": _BLANK}.get(kind[0], _MARK)
        if kind == "Cn":
            table[point] = _UNSURE
    table[[0x09, 0x0A, 0x0D, 0x20]] = _BLANK
    return table


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.classes = _classes()
        self.codes = mix(np.arange(1, len(self.classes) + 1, dtype=np.uint64)) | np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces, owner = [], []
        for k, text in enumerate(texts):
            low = 0
            while len(text) - low > PIECE_CHARS:  # no part crosses from a character to a blank
                found = _CUT.search(text, low + PIECE_CHARS)
                if not found:
                    break
                pieces.append(text[low : found.start()])
                owner.append(k)
                low = found.start()
            pieces.append(text[low:] if low else text)
            owner.append(k)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        low = size = 0
        for high in range(1, len(pieces) + 1):
            size += len(pieces[high - 1])
            if size >= PIECE_CHARS or high == len(pieces):
                for k, ids in zip(owner[low:high], self._encode(pieces[low:high]), strict=True):
                    out[k].append(ids)
                low, size = high, 0
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = np.full(len(points), _UNSURE, dtype=np.uint8)
        low = points < len(self.classes)
        kinds[low] = self.classes[points[low]]
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        unsure = np.concatenate([[0], np.cumsum(kinds == _UNSURE)])
        odd = (unsure[begins + sizes] - unsure[begins]) > 0
        if odd.any():
            plain = iter(self._encode([t for t, o in zip(texts, odd, strict=True) if not o]) if not odd.all() else [])
            return [self._whole(t) if o else next(plain) for t, o in zip(texts, odd, strict=True)]
        if not len(points):
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        starts = self._starts(points, kinds, begins[sizes > 0])
        ends = np.append(starts[1:], len(points))
        up, down = powers(_BASE, len(points) + 1)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(self.codes[points] * up[: len(points)], out=sums[1:])
        hashes = mix(spans(sums, down, starts, ends) + (ends - starts).astype(np.uint64))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = self._places(distinct, first, starts, ends, points)
        sizes_of, at = self.sizes[place][which], self.at[place][which]
        total = np.concatenate([[0], np.cumsum(sizes_of)])
        ids = self.ids[np.repeat(at - total[:-1], sizes_of) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, np.append(begins, len(points)))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    @staticmethod
    def _starts(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where the parts begin, as the tokenizer splits them."""
        n = len(points)
        first = np.zeros(n + 1, dtype=bool)
        first[begins] = True
        start = first[:n].copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # a blank before a part: a space joins it, another blank stands alone; blanks before that form their own part
        after = np.flatnonzero((kinds[1:] != _BLANK) & (kinds[:-1] == _BLANK) & ~first[1:n]) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 0x20]] = False
        marks = np.flatnonzero((points == 0x27) & start)
        marks = marks[(marks + 1 < n)]
        marks = marks[~first[marks + 1]]
        for p in marks.tolist():
            tail = "".join(map(chr, points[p + 1 : p + 3].tolist()))
            if p + 2 < n and first[p + 2]:
                tail = tail[:1]
            ending = next((e for e in _ENDINGS if tail.startswith(e)), None)
            if ending:
                start[p + 1 : p + 1 + len(ending)] = False
                if p + 1 + len(ending) < n:
                    start[p + 1 + len(ending)] = True
        return np.flatnonzero(start)

    def _places(self, distinct, first, starts, ends, points) -> np.ndarray:
        """Places of the distinct parts in the table; new parts are encoded and added."""
        if len(self.keys) > MAX_PARTS:
            self._forget()
        where = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(where, len(self.keys) - 1)] == distinct
        new = np.flatnonzero(~known)
        if len(new):
            parts = [points[starts[k] : ends[k]].tobytes().decode("utf-32-le") for k in first[new].tolist()]
            coded = self._code(parts)
            sizes = np.array([len(c) for c in coded], dtype=np.int64)
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.uint32, int(sizes.sum()))])
            self.keys = np.insert(self.keys, where[new], distinct[new])
            self.at = np.insert(self.at, where[new], at)
            self.sizes = np.insert(self.sizes, where[new], sizes)
            where = np.searchsorted(self.keys, distinct)
        return where

    def _code(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part. Parts that begin with a space are encoded many at a time: they stay apart in one text."""
        coded: list[list[int]] = [[] for _ in parts]
        joined = [k for k, p in enumerate(parts) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        for low in range(0, len(joined), 256):
            group = joined[low : low + 256]
            got = self.tokenizer.encode("".join(parts[k] for k in group), add_special_tokens=False)
            words = got.word_ids
            if words and words[-1] == len(group) - 1:
                for word, i in zip(words, got.ids, strict=True):
                    coded[group[word]].append(i)
        for k, p in enumerate(parts):
            if not coded[k]:
                coded[k] = self.tokenizer.encode(p, add_special_tokens=False).ids
        return coded
