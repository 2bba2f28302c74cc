"""URL filters: all glob rules are simulated at once, bit by bit, over each canonical address.

A rule names a host and the beginning of a path; either may hold ``*`` (any characters, none
included; in a host not beyond it) and ``?`` (one character). Every rule becomes two patterns, one for the host itself and one
for its subdomains. The states of all patterns lie side by side in a row of 64-bit words. Reading one
character shifts all words by a bit, keeps the states that the character allows and those that a ``*``
lets wait. A batch of addresses is read in step, so the work is a few array operations per character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.words import utf8

_SEPARATOR = 0xFF  # between host and path; no byte of UTF-8


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str = ""

    def __str__(self) -> str:
        return self.host + self.path


#: Rules of the production query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_RESULT = "page_id long, host string, path string, rule string, verdict string"


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, otherwise: str = "allow") -> DataFrame:
    """Allow or block each page by the longest rule that fits its address.

    ``pages``: ``page_id`` and ``source_url``; other columns are ignored. The host is what follows the first ``://`` up to
    ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path follows up to ``?``, ``#`` or the end. A null address or one
    without ``://`` has an empty host and path. A rule fits its host and all subdomains if the path starts with the rule's. Of rules
    of one length ``block`` wins, then the text that sorts first.

    Returns one row per input row: ``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``
    (``otherwise`` if none fits).
    """
    address = F.coalesce(F.col("source_url").cast("string"), F.lit(""))
    split = pages.select(
        F.col("page_id").cast("long"),
        F.translate(F.regexp_extract(address, _ADDRESS, 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(address, _ADDRESS, 2).alias("path"),
    )
    ordered = sorted(set(rules), key=lambda r: (-len(str(r)), r.verdict != "block", str(r), r.host))
    return split.mapInArrow(partial(_judge, ordered, otherwise), _RESULT)


class Automaton:
    """Shift-And masks of several glob patterns, given as ``(prefix of the host, host, path)`` rules."""

    def __init__(self, rules: Sequence[UrlRule]):
        patterns = [self._symbols(before + r.host, r.path) for r in rules for before in ("", "*.")]
        sizes = [1 + sum(s != "*" for s in p) for p in patterns]
        self.ends = np.cumsum([0, *sizes])[1:] - 1
        words = max(1, -(-int(sum(sizes)) // 64))
        self.first = np.zeros(words, dtype=np.uint64)
        self.step = np.zeros((256, words), dtype=np.uint64)  # states that a character leads to
        self.wait = np.zeros((256, words), dtype=np.uint64)  # states that a character leaves
        at = 0
        for pattern in patterns:
            self._set(self.first, at)
            in_host = True
            for symbol in pattern:
                if symbol == "*":
                    for byte in range(256):
                        if byte != _SEPARATOR or not in_host:
                            self._set(self.wait[byte], at)
                    continue
                at += 1
                in_host = in_host and symbol != _SEPARATOR
                for byte in (b for b in range(256) if b != _SEPARATOR) if symbol == "?" else (symbol,):
                    self._set(self.step[byte], at)
            at += 1

    @staticmethod
    def _symbols(host: str, path: str) -> list:
        def of(text: str) -> list:
            return [s for c in text for s in ([c] if c in "*?" else list(c.encode()))]

        return [*of(host), _SEPARATOR, *of(path), "*"]

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    def accepted(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each text (its bytes are ``data[start:end]``) and each pattern, whether it fits."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")  # longest first: texts still being read are a prefix
        sizes, begin = sizes[order], starts[order]
        state = np.tile(self.first, (len(order), 1))
        left = len(order)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            while left and sizes[left - 1] <= k:
                left -= 1
            now, byte = state[:left], data[begin[:left] + k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:left] = (moved & self.step[byte]) | (now & self.wait[byte])
        out = np.empty((len(order), len(self.ends)), dtype=bool)
        out[order] = (state[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & np.uint64(1) != 0
        return out


def _judge(rules: list[UrlRule], otherwise: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton(rules)
    names = pa.array([*map(str, rules), None], pa.string())
    verdicts = pa.array([*(r.verdict for r in rules), otherwise], pa.string())
    for batch in batches:
        host, host_at = utf8(batch.column("host"))
        path, path_at = utf8(batch.column("path"))
        n = batch.num_rows
        sizes = np.diff(host_at) + 1 + np.diff(path_at)
        ends = np.cumsum(sizes)
        data = np.full(int(sizes.sum()), _SEPARATOR, dtype=np.uint8)
        text = np.repeat(np.arange(n), sizes)
        within = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        in_host = within < np.diff(host_at)[text]
        in_path = within > np.diff(host_at)[text]
        data[in_host] = host
        data[in_path] = path
        fits = automaton.accepted(data, ends - sizes, ends).reshape(n, len(rules), 2).any(axis=2)
        best = np.where(fits.any(axis=1), fits.argmax(axis=1) if rules else 0, len(rules))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("host"), batch.column("path"), names.take(pa.array(best)), verdicts.take(pa.array(best))],
            ["page_id", "host", "path", "rule", "verdict"],
        )
