"""Blocks of texts and slices of hash values: how facts about all texts meet and find their way back.

A block is a bounded share of the dossiers, a slice a bounded share of the hash values. Each block
sends every slice the sorted hashes it holds, once each, so that copies within a block are merged
before the shuffle and a hash that stands in a third of all dossiers reaches its slice once per
block, not once per dossier. The slice combines what the blocks sent and answers each of them.
Which block a dossier belongs to depends on its content only, so a task that is run again on another
executor sends and receives the same. All steps of an operator read one shuffle of the texts.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes of a block and hash values of a slice, at least.
BLOCK_BYTES = 6 << 20
SLICE_VALUES = 1 << 20
#: Blocks of operators that need many arrays for each word.
SMALL_BLOCK_BYTES = 3 << 20
#: Both grow with the root of the corpus from the point where so many values would make up a message from a block to a slice (about
#: 13 GB of text), so messages do not become smaller: 512 MB at 100 TB, for executors with memory for ten times that.
MESSAGE_VALUES = 480
WORD_BYTES = 6
#: Stands for a missing id: such dossiers come after all others.
NO_ID = np.iinfo(np.int64).max

MESSAGES = "slice int, block int, payload binary"
_ARROW_MESSAGES = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])


def block_size(text_bytes: int, least: int = BLOCK_BYTES) -> int:
    """Text bytes of a block of a corpus of so many."""
    return max(least, math.isqrt(text_bytes * MESSAGE_VALUES * BLOCK_BYTES // SLICE_VALUES))


def slice_bits(values: int, least: int = 4, slice_values: int = SLICE_VALUES) -> int:
    """Slices (as a power of two) for so many hash values."""
    most = max(slice_values, math.isqrt(values * slice_values * WORD_BYTES * MESSAGE_VALUES // BLOCK_BYTES))
    return max(least, math.ceil(math.log2(max(1, values / most))))


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: None


def freed(result: pa.Table | None = None) -> pa.Table | None:
    """``result``, after memory that this worker no longer uses went back to the system: workers live on, idle ones through stages of others."""
    pa.default_memory_pool().release_unused()
    _trim()(0)
    return result


class Blocks:
    """Dossiers as ``(block, recipe_id, text)``, dealt by block; other columns are left out unless ``carried``."""

    def __init__(self, dossiers: DataFrame, block_bytes: int | None = None, carried: Column | None = None, least: int = BLOCK_BYTES):
        more = [] if carried is None else [carried.alias("carried")]
        texts = dossiers.select(F.col("recipe_id").cast("long"), F.col("text").cast("string"), *more)
        size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
        self.rows, self.bytes = size["n"], size["b"] or 0
        self.count = max(1, -(-(self.bytes + 16 * self.rows) // (block_bytes or block_size(self.bytes, least))))
        block = F.pmod(F.xxhash64("recipe_id", "text"), F.lit(self.count)).cast("int")
        self.frame = texts.withColumn("block", block).repartition(self.count, "block")

    def send(self, fn, schema: str = MESSAGES) -> DataFrame:
        """``fn(block number, table of dossiers) -> table`` for each block."""

        def run(key, table):
            return freed(fn(key[0].as_py(), table))

        return self.frame.groupBy("block").applyInArrow(run, schema)

    def receive(self, answers: DataFrame, fn, schema: str) -> DataFrame:
        """``fn(block number, table of dossiers, payloads of the answers) -> table`` for each block."""

        def run(key, table, answered):
            # what an empty side's key looks like differs between Spark versions
            if table.num_rows == 0:
                return pa.table({})
            return freed(fn(table["block"][0].as_py(), table, answered["payload"].to_pylist()))

        return self.frame.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def combine(messages: DataFrame, fn) -> DataFrame:
    """Per slice, ``fn(slice number, block numbers, payloads) -> iterator of (block, payload)`` as ``(block, payload)``."""

    def run(key, table):
        out = list(fn(key[0].as_py(), table["block"].to_pylist(), table["payload"].to_pylist()))
        blocks, payloads = pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())
        out.clear()
        return freed(pa.table({"block": blocks, "payload": payloads}))

    return messages.groupBy("slice").applyInArrow(run, "block int, payload binary")


def messages(block: int, parts: Iterator[tuple[int, bytes]]) -> pa.Table:
    """Arrow table of the messages of one block: ``(slice, payload)`` pairs."""
    parts = list(parts)
    return pa.table(
        {
            "slice": pa.array([s for s, _ in parts], pa.int32()),
            "block": pa.array([block] * len(parts), pa.int32()),
            "payload": pa.array([p for _, p in parts], pa.binary()),
        },
        schema=_ARROW_MESSAGES,
    )


def cut(values: np.ndarray, bits: int, width: int = 64) -> Iterator[tuple[int, int, int]]:
    """``(slice, low, high)`` of sorted values of ``width`` bits, sliced by their top ``bits`` bits; slices without values are passed over."""
    top = values >> np.uint64(width - bits) if bits else np.zeros(len(values), dtype=np.uint64)
    starts = np.flatnonzero(np.diff(top, prepend=~top[:1]))
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(values)], strict=True) if len(values) else ():
        yield int(top[low]), low, high


def pack(*columns: np.ndarray) -> bytes:
    """Integer columns of one length as bytes. The first must be sorted: its steps are stored."""
    press = zstandard.ZstdCompressor(level=1)
    parts = [len(columns[0]).to_bytes(8, "little")]
    for k, column in enumerate(columns):
        values = np.ascontiguousarray(column).astype(np.uint64)
        if k == 0 and len(values):
            values = np.diff(values, prepend=np.uint64(0))
        planes = values.view(np.uint8).reshape(-1, 8).T
        used = 8
        while used and not planes[used - 1].any():
            used -= 1
        body = press.compress(np.ascontiguousarray(planes[:used]).tobytes())
        parts += [used.to_bytes(1, "little"), len(body).to_bytes(8, "little"), body]
    return b"".join(parts)


def unpack(payload: bytes) -> list[np.ndarray]:
    """The columns that :func:`pack` stored, as uint64."""
    press = zstandard.ZstdDecompressor()
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    while at < len(payload):
        used, size = payload[at], int.from_bytes(payload[at + 1 : at + 9], "little")
        body = press.decompress(payload[at + 9 : at + 9 + size], max_output_size=max(1, n * used))
        planes = np.zeros((8, n), dtype=np.uint8)
        planes[:used] = np.frombuffer(body, dtype=np.uint8).reshape(used, n)
        values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
        out.append(np.cumsum(values, dtype=np.uint64) if not out else values)
        at += 9 + size
    return out


def gather(payloads: list[bytes], columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns of all payloads end to end, the payload each row came from, and where each payload begins."""
    parts = [unpack(p) for p in payloads]
    sizes = np.array([len(p[0]) for p in parts], dtype=np.int64)
    joined = [np.concatenate([np.zeros(0, dtype=np.uint64), *(p[k] for p in parts)]) for k in range(columns)]
    return joined, np.repeat(np.arange(len(parts)), sizes), np.concatenate([[0], np.cumsum(sizes)])


def ids_of(table: pa.Table) -> np.ndarray:
    """The ids of a block's dossiers; a missing one is NO_ID."""
    return table["recipe_id"].combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def lookup(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each key in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)
