"""Cost-balanced packing of tokenized dossiers into sequences.

A dossier is cut into pieces of at most ``capacity`` tokens. A piece costs a linear and a quadratic share (attention looks
within its own piece). In descending order of cost each piece goes to the sequence that has cost least so
far and still has room. Pieces are dealt into groups of bounded size by a hash of their columns and place and each group is packed on its own; all that
moves between tasks is a narrow row per piece.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.blocks import freed
from larder.llm.tokens import encoder
from larder.session import ensure_checkpoint_dir

CAPACITY = 2048
END_ID = 1
GROUP_PIECES = 4096
#: Cost of a token by itself, and of a token attending to another.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "recipe_id long, start long, length long, ids_crc32 long, doc_tokens long"
RESULT = PIECES + ", sequence_id long, offset long, cost double"
_COLUMNS = ["recipe_id", "start", "length", "ids_crc32", "doc_tokens"]


def cut_pieces(dossiers: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole dossiers and cut them into pieces of ``capacity`` tokens and a rest.

    ``dossiers``: ``recipe_id`` and ``text``; other columns are ignored. A null or empty text is the end id alone. ``ids_crc32`` is over the
    little-endian 32-bit ids. ``tokenizer_path`` must be readable on all executors.
    """
    texts = dossiers.select(F.col("recipe_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(partial(_cut, tokenizer_path, capacity, end_id), PIECES)


def pack_dossiers(
    dossiers: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Pack all dossiers; one row per piece with its sequence and its place there.

    Returns the columns of :func:`cut_pieces` and ``sequence_id``, ``offset`` (gapless from 0) and the ``cost`` of the piece. Repeated rows
    are packed once each, in as many groups as others. An empty table gives an empty one. Ties are broken by id, start and checksum. The pieces are written to the shared folder first, so
    texts are tokenized once.
    """
    spark = dossiers.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    cut_pieces(dossiers, tokenizer_path, capacity, end_id).write.parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    groups = max(1, -(-pieces.count() // group_pieces))
    # The place of a piece in the written files deals out pieces that are alike, too. Files do not change, so a task that runs again deals the same.
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1)
    key = F.pmod(F.xxhash64(*_COLUMNS, part, F.col("_metadata.row_index")), F.lit(groups)).alias("pack_group")

    def pack(table):
        return _pack(capacity, table)

    return pieces.select("*", key).groupBy("pack_group").applyInArrow(pack, RESULT)


def _cut(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = encoder(path)
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            owner, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(coder.encode(part.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), capacity):
                    piece = ids[a : a + capacity]
                    owner.append(k)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
            columns = [part.column("recipe_id").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, _COLUMNS)
    freed()


def balance(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and cost of each piece; ``lengths`` in descending order."""
    costs = LINEAR * lengths + QUADRATIC * lengths.astype(np.float64) ** 2
    opened = max(1, -(-int(lengths.sum()) // capacity))
    room = np.full(len(lengths) + opened, capacity, dtype=np.int64)
    spent = np.full(len(room), np.inf)
    spent[:opened] = 0.0
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for k, (length, cost) in enumerate(zip(lengths.tolist(), costs.tolist(), strict=True)):
        best = int(np.where(room[:opened] >= length, spent[:opened], np.inf).argmin())
        if room[best] < length:
            best = opened
            opened += 1
            spent[best] = 0.0
        sequence[k], offset[k] = best, capacity - room[best]
        room[best] -= length
        spent[best] += cost
    used = np.flatnonzero(room[:opened] < capacity)  # number the sequences without gaps
    return np.searchsorted(used, sequence), offset, costs


def _pack(capacity: int, table: pa.Table) -> pa.Table:
    group = table["pack_group"][0].as_py()
    table = table.select(_COLUMNS).sort_by(
        [("length", "descending"), ("recipe_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
    )
    sequence, offset, cost = balance(table["length"].to_numpy().astype(np.int64), capacity)
    return (
        table.append_column("sequence_id", pa.array(sequence + (group << 32), pa.int64()))
        .append_column("offset", pa.array(offset, pa.int64()))
        .append_column("cost", pa.array(cost, pa.float64()))
    )
