"""An interpolated modified Kneser-Ney model of any order from 2 on, counted over the corpus as sorted hash arrays.

Words: each is known by a 64-bit hash; slices of the hashes count the words of the texts to learn from and number them, frequent ones first.
Blocks of dossiers ask for the numbers of their words, each once, and are stored as numbers. All further messages hold numbers, which take a third of
the bytes of hashes. A word that is in no text to learn from has no number of its own, nor is a gram with one asked for.

Counting: a gram of level k is k words in a row; level 1 is the words. Each block sends slices of the grams' hashes the grams that it holds,
each once with its count. A slice adds the counts up, as sorted arrays, and passes on to the level below, summed per gram, what its grams say of the grams they
begin with (as contexts) and end with (continuations). The highest level counts how often a gram stands in the texts, the levels below how many
different words stand before it; a gram at the begin of a text has none and counts as often as it stands there. Grams are told apart by 64-bit hashes.
Nothing is pruned, so the model grows with the corpus, beyond what one worker could hold.

Scoring: a slice answers each block, in the order of its message, what the arrays hold of the grams asked for. A worker searches them
memory-mapped (from an unlinked scratch file, so that pages it does not touch take no memory). Where the texts that are scored hold those to learn from
(:func:`learn_and_score`), the message that counts a gram asks for it, too; else (:func:`score_dossiers`) the arrays are read from the stored model.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.blocks import Blocks, cut, freed, gather, lookup, messages, pack, slice_bits, unpack
from larder.llm.words import PLAIN, Words, mix
from larder.session import ensure_checkpoint_dir

#: Words of a gram of the highest level.
ORDER = 3
#: Hash of the end of a text.
END = np.uint64(0)
#: Numbers that are not words: what stands before the begin of a text, the begin, and any word without a number.
PAD, BEGIN, UNKNOWN, FIRST = 0, 1, 2, 3
#: Kinds of messages to a slice and of rows it makes: of a block or to one, from the level above or to that below, arrays of a stored model, figures.
BLOCK, ENDS, BEGINS, ARRAYS, FIGURES = 0, 1, 2, 3, 4
_SLICED = "kind int, slice int, block int, payload binary"
_TALLIED = f"{_SLICED}, tallies array<long>"
_NUMBERED = "block int, recipe_ids array<long>, learns array<boolean>, n_tokens array<long>, n_known array<long>, count_logs array<double>, numbers binary, tokens binary"
_NUMBERED_TYPES = {
    "block": pa.int32(),
    "recipe_ids": pa.list_(pa.int64()),
    "learns": pa.list_(pa.bool_()),
    "n_tokens": pa.list_(pa.int64()),
    "n_known": pa.list_(pa.int64()),
    "count_logs": pa.list_(pa.float64()),
    "numbers": pa.binary(),
    "tokens": pa.binary(),
}
_ASKING = ("block", "learns", "n_tokens", "numbers", "tokens")
SCORES = "recipe_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class LanguageModel:
    """Where the arrays are, and the figures of the whole corpus."""

    folder: str | None  # None: the arrays were not kept
    order: int
    gram_bits: int  # slices of the grams of a level, as a power of two
    word_bits: int  # slices of words
    tokens: int
    distinct: int
    pair_types: int
    gram_discounts: tuple[tuple[float, float, float], ...]  # of level 2 and up
    word_discounts: tuple[float, float, float]
    word_backoff: float  # share of the word level left for words never seen


def train_language_model(dossiers: DataFrame, order: int = ORDER) -> LanguageModel:
    """Count a model over whole dossiers and store it in the shared folder.

    ``dossiers``: ``recipe_id`` and ``text``; other columns are ignored. Tokens: words separated by blanks, A-Z in lower case, then one end; the first token
    follows a begin. A null or empty text is the end alone. Repeated rows count again. Without rows the model knows nothing. A token
    depends on the ``order - 1`` before it.
    """
    return _learn(dossiers, F.lit(True), order, None, kept=True)[0]


def learn_and_score(dossiers: DataFrame, learns: Column, order: int = ORDER, block_bytes: int | None = None) -> tuple[LanguageModel, DataFrame]:
    """:func:`train_language_model` on the dossiers of which ``learns`` holds, and :func:`score_dossiers` of all of them, in one pass over their grams.

    The arrays of the model are not kept.
    """
    spark = dossiers.sparkSession
    model, folder = _learn(dossiers, F.coalesce(learns, F.lit(False)), order, block_bytes, kept=False)
    answers = None
    for level in range(order, 0, -1):
        made = _stored(spark, f"{folder}/{level}", _TALLIED).filter(F.col("kind") == BLOCK).select("block", "payload")
        answers = made if answers is None else answers.unionByName(made)
    return model, _scores(_stored(spark, f"{folder}/blocks", _NUMBERED).filter("block >= 0"), answers, model, counted=True)


def score_dossiers(dossiers: DataFrame, model: LanguageModel, block_bytes: int | None = None) -> DataFrame:
    """Score whole dossiers: one row per input row.

    ``n_tokens`` (with the end), ``n_known`` (seen in training), ``base_score`` (log10 of the smoothed frequencies of the tokens, added up) and
    ``score``, the model's log10 probability of the text; its perplexity is ``10 ** (-score / n_tokens)``. A word never seen has the share of one unknown
    word. Repeated rows score alike.
    """
    if model.folder is None:
        raise ValueError("the arrays of this model were not kept")
    spark = dossiers.sparkSession
    folder = _new_folder(spark)
    with _shuffles_freed(spark):
        words = _stored(spark, f"{model.folder}/blocks", _NUMBERED).filter("block < 0").selectExpr("-1 - block as slice", "tokens as payload")
        blocks = _number(Blocks(dossiers, block_bytes, carried=F.lit(False)), words, model.word_bits, True, folder).filter("block >= 0")
    answers = None
    for level in range(model.order, 0, -1):
        bits = model.gram_bits if level > 1 else model.word_bits
        asked = blocks.select(*_ASKING).mapInArrow(partial(_ask, level, False, bits), _SLICED)
        arrays = _stored(spark, f"{model.folder}/{level}", _TALLIED).filter(F.col("kind") == ARRAYS).select("kind", "slice", "block", "payload")
        made = _sliced(asked.unionByName(arrays), level, model.order, None, answered=True, kept=False).select("block", "payload")
        answers = made if answers is None else answers.unionByName(made)
    return _scores(blocks, answers, model, counted=False)


def _learn(dossiers: DataFrame, learns: Column, order: int, block_bytes: int | None, kept: bool) -> tuple[LanguageModel, str]:
    """The model, and the folder of its words, of the numbered blocks and, per level, of the arrays or the answers to the blocks."""
    if order < 2:
        raise ValueError(f"order {order} is below 2")
    spark = dossiers.sparkSession
    folder = _new_folder(spark)
    blocks = Blocks(dossiers, block_bytes, carried=learns)
    gram_bits = slice_bits(max(2, blocks.bytes // 6 + blocks.rows))
    word_bits = max(4, gram_bits - 2)
    figures = {}
    with _shuffles_freed(spark):
        numbered = _number(blocks, None, word_bits, kept, folder)
        different, tokens = _totals(numbered.filter("block < 0").select(F.col("n_tokens").alias("tallies")), 2)
        numbered = numbered.filter("block >= 0")
        above = None
        for level in range(order, 0, -1):
            bits, below = (gram_bits if k > 1 else word_bits for k in (level, level - 1))
            sliced = above
            if level == order or not kept:
                asked = numbered.select(*_ASKING).mapInArrow(partial(_ask, level, level == order, bits), _SLICED)
                sliced = asked if above is None else asked.unionByName(above)
            _sliced(sliced, level, order, below, answered=not kept, kept=kept).write.partitionBy("kind").parquet(f"{folder}/{level}")
            if level < order:
                for kind in (ENDS, BEGINS):
                    _emptied(spark, f"{folder}/{level + 1}/kind={kind}")
            tallied = _stored(spark, f"{folder}/{level}", _TALLIED)
            figures[level] = _totals(tallied.filter(F.col("kind") == FIGURES), 5)
            above = tallied.filter(F.col("kind").isin(ENDS, BEGINS)).select("kind", "slice", "block", "payload")

    pair_types = figures[2][4]
    discounts = _discounts(figures[1])
    once, twice, _, _, ends = figures[1]
    backoff = discounts[0] * once + discounts[1] * twice + discounts[2] * (ends - once - twice)
    model = LanguageModel(
        folder if kept else None, order, gram_bits, word_bits, tokens, different, pair_types,
        tuple(_discounts(figures[k]) for k in range(2, order + 1)), discounts, backoff / pair_types if pair_types else 1.0,
    )
    return model, folder


def _number(blocks: Blocks, words: DataFrame | None, word_bits: int, kept: bool, folder: str) -> DataFrame:
    """The blocks, stored as numbers of words, with what the words alone tell of each dossier.

    Without ``words`` they are counted and numbered; then there is also a row for each slice of words, of a block below 0, with how many different words
    and tokens it has, and its arrays if these are ``kept``.
    """

    def number(key, asked):
        return freed(_number_words(word_bits, kept, key[0].as_py(), asked))

    def answer(key, asked, known):
        return freed(_answer_words(asked, known))

    def receive(key, table, answered):
        payloads = answered["payload"].to_pylist()
        # what an empty side's key looks like differs between Spark versions
        return freed(_numbered(table, payloads) if table.num_rows else _words_row(answered["block"][0].as_py(), payloads[0]))

    asked = blocks.send(partial(_ask_words, word_bits))
    schema = "block int, payload binary"
    if words is None:
        answers = asked.groupBy("slice").applyInArrow(number, schema)
    else:
        answers = asked.groupBy("slice").cogroup(words.groupBy("slice")).applyInArrow(answer, schema)
    made = blocks.frame.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(receive, _NUMBERED)
    made.write.parquet(f"{folder}/blocks")
    return _stored(blocks.frame.sparkSession, f"{folder}/blocks", _NUMBERED)


def _sliced(messages: DataFrame, level: int, order: int, bits_below: int | None, answered: bool, kept: bool) -> DataFrame:
    def run(key, table):
        return freed(_slice(level, order, bits_below, answered, kept, key[0].as_py(), table))

    return messages.groupBy("slice").applyInArrow(run, _TALLIED)


def _scores(blocks: DataFrame, answers: DataFrame, model: LanguageModel, counted: bool) -> DataFrame:
    def run(key, table, answered):
        # what an empty side's key looks like differs between Spark versions
        if table.num_rows == 0:
            return pa.table({})
        return freed(_score(model, counted, table, answered["payload"].to_pylist()))

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES)


def _new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/language-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _emptied(spark: SparkSession, path: str) -> None:
    """What is stored there was read for the last time and makes room."""
    spark.createDataFrame([], "payload binary").coalesce(1).write.mode("overwrite").parquet(path)


def _totals(tallied: DataFrame, n: int) -> list[int]:
    sums = tallied.agg(*[F.sum(F.col("tallies")[k]).alias(f"t{k}") for k in range(n)]).first()
    return [s or 0 for s in sums]


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each job's shuffle files go when its rows are stored, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _word_hashes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and how many each text has."""
    words = Words(texts, PLAIN, lower=True)
    return np.insert(np.maximum(words.hashes, np.uint64(1)), words.first[1:], END), words.counts + 1


def _ask_words(word_bits: int, block: int, table: pa.Table) -> pa.Table:
    """Messages with the words of a block, and how often they stand in its dossiers to learn from."""
    hashes, n_tokens = _word_hashes(table["text"])
    learns = np.repeat(table["carried"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool), n_tokens)
    words, (counts,), _ = _merged(hashes, [learns.astype(np.uint64)])
    return messages(block, ((s, pack(words[a:b], counts[a:b])) for s, a, b in cut(words, word_bits)))


def _number_words(word_bits: int, kept: bool, slice_number: int, asked: pa.Table) -> pa.Table:
    """Number the words of a slice, and answer the blocks; slices take turns in numbering, so the frequent words of all have small numbers."""
    payloads = asked["payload"].to_pylist()
    (words, counts), _, _ = gather(payloads, 2)
    words, (counts,), _ = _merged(words, [counts])
    words, counts = words[counts > 0], counts[counts > 0]
    numbers = np.empty(len(words), dtype=np.uint64)
    numbers[np.argsort(-counts.astype(np.int64), kind="stable")] = np.arange(len(words), dtype=np.uint64)
    numbers = (numbers << np.uint64(word_bits)) + np.uint64(slice_number + FIRST)
    arrays = pack(words, numbers, counts) if kept else b""
    figures = b"".join(n.to_bytes(8, "little") for n in (len(words), int(counts.sum())))
    answers = _word_answers(slice_number, payloads, [words, numbers, counts])
    blocks = pa.array([-1 - slice_number, *asked["block"].to_pylist()], pa.int32())
    return pa.table({"block": blocks, "payload": pa.array([figures + arrays, *answers], pa.binary())})


def _words_row(block: int, payload: bytes) -> pa.Table:
    figures = [int.from_bytes(payload[k : k + 8], "little") for k in (0, 8)]
    columns = {n: pa.nulls(1, t) for n, t in _NUMBERED_TYPES.items()}
    columns |= {"block": pa.array([block], pa.int32()), "n_tokens": pa.array([figures], pa.list_(pa.int64())), "tokens": pa.array([payload[16:]], pa.binary())}
    return pa.table(columns)


def _answer_words(asked: pa.Table, known: pa.Table) -> pa.Table:
    answers = []
    if asked.num_rows:
        arrays = unpack(known["payload"][0].as_py()) if known.num_rows else [np.zeros(0, dtype=np.uint64)] * 3
        answers = _word_answers(asked["slice"][0].as_py(), asked["payload"].to_pylist(), arrays)
    return pa.table({"block": asked["block"].cast(pa.int32()) if answers else pa.array([], pa.int32()), "payload": pa.array(answers, pa.binary())})


def _word_answers(slice_number: int, payloads: list[bytes], arrays: list[np.ndarray]) -> list[bytes]:
    """Number and count of each word that a block asked for, in its order; zeros for a word that is not known."""
    arrays = _mapped(arrays)
    return [slice_number.to_bytes(4, "little") + _in_order(_found(unpack(p)[0], arrays)) for p in payloads]


def _numbered(table: pa.Table, answers: list[bytes]) -> pa.Table:
    hashes, n_tokens = _word_hashes(table["text"])
    at = _places(*_runs(hashes))
    answers = sorted(answers, key=lambda a: int.from_bytes(a[:4], "little"))
    (_, numbers, counts), _, _ = gather([a[4:] for a in answers], 3)
    logs = np.log10(counts.astype(np.float64) + 0.5)[at]
    owner = np.repeat(np.arange(table.num_rows), n_tokens)
    add = lambda x: np.bincount(owner, weights=x, minlength=table.num_rows)
    numbers = np.where(counts > 0, numbers, np.uint64(UNKNOWN))
    own = np.unique(np.append(numbers, np.uint64(UNKNOWN)))
    values = {
        "block": table["block"][0].as_py(),
        "recipe_ids": table["recipe_id"].to_pylist(),
        "learns": table["carried"].to_pylist(),
        "n_tokens": n_tokens,
        "n_known": add((counts > 0)[at]).astype(np.int64),
        "count_logs": add(logs),
        "numbers": pack(own),
        "tokens": _in_order([(np.searchsorted(own, numbers) + UNKNOWN)[at]]),  # their places among PAD, BEGIN and the numbers of the block
    }
    return pa.table({n: pa.array([values[n]], t) for n, t in _NUMBERED_TYPES.items()})


def _in_order(columns: list[np.ndarray]) -> bytes:
    """Columns of which none is sorted; :func:`unpack` gives a column of zeros before them."""
    return pack(np.zeros(len(columns[0]), dtype=np.uint64), *columns)


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of grams from the numbers of their words, one column for each place."""
    hashes = mix(columns[0])
    for column in columns[1:]:
        hashes = mix(hashes + column)
    return hashes


class _Grams:
    """The grams of a level that a block holds, each once, in the order of their words, in which they take the fewest bytes."""

    def __init__(self, level: int, padded: bool, bits: int, row: dict, counted: bool = False):
        own = np.concatenate([np.array([PAD, BEGIN], dtype=np.uint64), unpack(row["numbers"])[0]])
        if level == 1:  # all words of the block; the begin is a context, too
            self.asked = [np.delete(own, [PAD, UNKNOWN])]
            self.slices = _in_slices(gram_hashes(self.asked), bits)
            self.counts = np.zeros(len(self.asked[0]), dtype=np.uint64)
            self.tokens = row["tokens"]
            return
        tokens, n_tokens = unpack(row["tokens"])[1], np.array(row["n_tokens"], dtype=np.int64)
        at = np.arange(len(tokens)) - np.repeat(np.cumsum(n_tokens) - n_tokens, n_tokens)
        #: Which do not reach beyond the begin.
        self.whole = at >= level - 2
        self.is_asked = self.whole | padded
        columns = []
        for back in range(level - 1, -1, -1):
            column = tokens
            if back:
                column = np.concatenate([np.zeros(min(back, len(tokens)), dtype=np.uint64), tokens[: max(0, len(tokens) - back)]])
                column[at < back] = PAD
                column[at == back - 1] = BEGIN
            columns.append(column)
            self.is_asked &= column != UNKNOWN
        if not self.is_asked.all():
            columns = [c[self.is_asked] for c in columns]
        self.order, self.first = _runs(_joined(columns))
        row_of = self.order[self.first]
        self.asked = [own[c[row_of]] for c in columns]
        self.slices = _in_slices(gram_hashes(self.asked), bits)
        self.counts = np.zeros(len(row_of), dtype=np.uint64)
        if counted and len(row_of):
            learns = np.repeat(np.array(row["learns"], dtype=np.uint64), n_tokens)[self.is_asked]
            self.counts = np.add.reduceat(learns[self.order], self.first)

    def places(self) -> np.ndarray:
        """The place of each token's gram among the different ones; after them all where it is not asked for."""
        places = np.full(len(self.is_asked), len(self.first), dtype=np.int64)
        places[self.is_asked] = _places(self.order, self.first)
        return places

    def word_places(self) -> np.ndarray:
        """:meth:`places` of level 1; the begin has the first."""
        tokens = unpack(self.tokens)[1].astype(np.int64)
        return np.where(tokens == UNKNOWN, len(self.counts), tokens - UNKNOWN)

    def answered(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        """What was answered in the order of the messages, by the place of the gram; zero where it was not asked for."""
        place = np.concatenate([np.zeros(0, dtype=np.int64), *(p for _, p in self.slices)])
        out = []
        for column in columns:
            out.append(np.zeros(len(place) + 1))
            out[-1][place] = column
        return out


def _joined(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each row, in the order of the columns and different for different rows."""
    key, used = columns[0], 64
    for k, column in enumerate(columns):
        width = int(column.max()).bit_length() if len(column) else 0
        if k == 0:
            used = width
            continue
        if used + width > 64:
            key = _places(*_runs(key)).astype(np.uint64)
            used = int(key.max()).bit_length()
        key = (key << np.uint64(width)) | column
        used += width
    return key


def _in_slices(hashes: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Per slice of the hashes, the places of its rows, in the order in which they are."""
    top = (hashes >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(top, kind="stable")
    top = top[order]
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(top) else order
    return [(int(top[a]), order[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(top)], strict=len(top) > 0)]


def _ask(level: int, counted: bool, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages with the grams of each block, and if ``counted`` how often they stand in its dossiers to learn from."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in _ASKING}
            grams = _Grams(level, counted, bits, row, counted)
            rows = [(BLOCK, s, row["block"], pack(*(c[p] for c in grams.asked), grams.counts[p])) for s, p in grams.slices]
            yield from _table(rows, _SLICED_TYPES).to_batches()


_SLICED_TYPES = {"kind": pa.int32(), "slice": pa.int32(), "block": pa.int32(), "payload": pa.binary()}
_TALLIED_TYPES = {**_SLICED_TYPES, "tallies": pa.list_(pa.int64())}


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, types.items(), strict=True)})


def _frequencies(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4, and how many there are."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts)]


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of the keys by as many of their bits as leave room for their places: sorting numbers is faster than sorting places."""
    room = np.uint64(len(keys).bit_length())
    spare = max(0, (int(keys.max()).bit_length() if len(keys) else 0) + int(room) - 64)
    packed = np.sort((keys >> np.uint64(spare) << room) | np.arange(len(keys), dtype=np.uint64))
    return (packed & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each kind begins."""
    order = _order(keys) if len(keys) and int(keys.max()).bit_length() + len(keys).bit_length() <= 64 else np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return order, np.flatnonzero(new)


def _places(order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The place of each key among the different ones."""
    places = np.empty(len(order), dtype=np.int64)
    places[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return places


def _merged(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Each key once, sorted, with its columns added up, and a row that each key came from."""
    order, first = _runs(keys)
    row = order[first]
    return keys[row], [np.add.reduceat(c[order], first) if len(first) else c for c in columns], row


def _slice(level: int, order: int, bits_below: int | None, answered: bool, kept: bool, number: int, table: pa.Table) -> pa.Table:
    """Add up what blocks and the level above sent of the grams of a slice, or take the stored arrays; pass on to the level below, and answer the blocks."""
    kinds, blocks, payloads = (table[c].to_pylist() for c in ("kind", "block", "payload"))
    own = [(b, unpack(p)) for k, b, p in zip(kinds, blocks, payloads, strict=True) if k == BLOCK]
    stored = [p for k, p in zip(kinds, payloads, strict=True) if k == ARRAYS]
    rows = []
    if bits_below is None:
        arrays = unpack(stored[0]) if stored else [np.zeros(0, dtype=np.uint64)] * (2 if level == order else 6)
    else:
        if level == order:
            columns = [np.concatenate([np.zeros(0, dtype=np.uint64), *(c[k] for _, c in own)]) for k in range(level + 1)]
            columns = [c[columns[-1] > 0] for c in columns]
            grams, sums, row = _merged(gram_hashes(columns[:level]), columns[level:])
            words = [c[row] for c in columns[:level]]
        else:
            of_kind = lambda kind: [p for k, p in zip(kinds, payloads, strict=True) if k == kind]
            words, grams, sums = _both(gather(of_kind(ENDS), level + 1)[0], gather(of_kind(BEGINS), level + 4)[0], level)
        whole = words[0] != PAD
        arrays = [a[whole] for a in (grams, *sums)]
        rows.append((FIGURES, number, None, None, _frequencies(arrays[1][arrays[1] > 0])))
        if kept:
            rows.append((ARRAYS, number, None, pack(*arrays), None))
        if level > 1:
            rows += [(kind, s, None, p, None) for kind, s, p in _passed_on(words, sums[0], whole, bits_below)]
    if answered:
        arrays = _mapped(arrays)
        for block, asked in own:
            found = _found(gram_hashes(asked[:level]), arrays)
            head = level.to_bytes(4, "little") + number.to_bytes(4, "little")
            rows.append((BLOCK, number, block, head + _in_order(found), None))
    return _table(rows, _TALLIED_TYPES)


def _both(ends: list[np.ndarray], begins: list[np.ndarray], level: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Words, hashes and added columns of the grams that the level above sent as ends and as begins."""
    grams, (counts,), row = _merged(gram_hashes(ends[:level]), ends[level:])
    words = [c[row] for c in ends[:level]]
    contexts, sums, row = _merged(gram_hashes(begins[:level]), begins[level:])
    alone = lookup(contexts, grams) < 0  # the begin of a text is the end of nothing
    if alone.any():
        grams = np.concatenate([grams, contexts[alone]])
        order = np.argsort(grams)
        grams = grams[order]
        words = [np.concatenate([w, c[row[alone]]])[order] for w, c in zip(words, begins[:level], strict=True)]
        counts = np.concatenate([counts, np.zeros(int(alone.sum()), dtype=np.uint64)])[order]
    columns = [counts]
    place = lookup(contexts, grams)
    for column in sums:
        columns.append(np.zeros(len(grams), dtype=np.uint64))
        columns[-1][place] = column
    return words, grams, columns


def _passed_on(words: list[np.ndarray], totals: np.ndarray, whole: np.ndarray, bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Per gram of the level below: in how many (or, at the begin of a text, how often) of these it is the end; of those that begin with it, what they
    count beyond three, added up, and how many count once, twice and more often."""
    counts = totals[whole]
    beyond = np.where(counts > 3, counts, np.uint64(3)) - np.uint64(3)
    begins = [beyond, *((counts == k).astype(np.uint64) for k in (1, 2)), (counts > 2).astype(np.uint64)]
    ends = [np.where(whole, np.uint64(1), totals)]
    for kind, shorter, columns in ((ENDS, words[1:], ends), (BEGINS, [w[whole] for w in words[:-1]], begins)):
        order, first = _runs(_joined(shorter))
        shorter = [c[order[first]] for c in shorter]
        sums = [np.add.reduceat(c[order], first) if len(first) else c for c in columns]
        for s, place in _in_slices(gram_hashes(shorter), bits):
            yield kind, s, pack(*(c[place] for c in (*shorter, *sums)))


def _discounts(frequencies: list[int]) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and more; fixed shares where the frequencies do not tell."""
    n1, n2, n3, n4 = frequencies[:4]
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True))


def _mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays in the fewest bytes, the first as it is, memory-mapped from a scratch file that has no name and goes with the last map."""
    arrays = arrays[:1] + [a.astype(np.min_scalar_type(a.max())) if len(a) else a for a in arrays[1:]]
    out = []
    with tempfile.TemporaryFile() as file:
        for a in arrays:
            a.tofile(file)
        file.flush()
        at = 0
        for a in arrays:
            out.append(np.memmap(file, dtype=a.dtype, mode="r", offset=at, shape=a.shape) if len(a) else a)
            at += a.nbytes
    return out


def _found(wanted: np.ndarray, arrays: list[np.ndarray]) -> list[np.ndarray]:
    """What the arrays hold of each hash, the first of them the sorted hashes; zeros for those not there."""
    order = _order(wanted)  # searches in order find what they read in the cache
    place = np.empty(len(wanted), dtype=np.int64)
    place[order] = lookup(wanted[order], arrays[0])
    return [np.where(place >= 0, c[np.maximum(place, 0)] if len(c) else 0, 0) for c in arrays[1:]]


def _discounted(counts: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def _score(model: LanguageModel, counted: bool, table: pa.Table, answers: list[bytes]) -> pa.Table:
    (row,) = table.select(["recipe_ids", "n_tokens", "n_known", "count_logs", "numbers", "tokens"]).to_pylist()
    n_tokens = np.array(row["n_tokens"], dtype=np.int64)
    answers = sorted(answers, key=lambda a: (int.from_bytes(a[:4], "little"), int.from_bytes(a[4:8], "little")))
    of_level = {k: [a[8:] for a in answers if int.from_bytes(a[:4], "little") == k] for k in range(1, model.order + 1)}

    def known(level: int) -> tuple[_Grams, list[np.ndarray]]:
        grams = _Grams(level, counted and level == model.order, model.gram_bits if level > 1 else model.word_bits, row)
        columns, _, _ = gather(of_level.pop(level), 2 if level == model.order else 6)
        return grams, grams.answered(columns[1:])

    words, (ends, *contexts) = known(1)
    v = model.distinct
    p = (_discounted(ends, model.word_discounts) / model.pair_types if model.pair_types else 0.0) + model.word_backoff / (v + 1)
    places = words.word_places()
    p = np.broadcast_to(p, ends.shape)[places]
    before = np.concatenate([np.zeros(1, dtype=np.int64), places[:-1]])
    before[np.cumsum(n_tokens) - n_tokens] = 0
    for level in range(2, model.order + 1):
        d1, d2, d3 = discounts = model.gram_discounts[level - 2]
        beyond, once, twice, more = (c[before] for c in contexts)
        context = beyond + once + 2 * twice + 3 * more
        grams, (counts, *contexts) = known(level)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = _discounted(counts, discounts)[places := grams.places()] / context + (d1 * once + d2 * twice + d3 * more) / context * p
        p = np.where(grams.whole & (context > 0), seen, p)
        before = np.concatenate([np.zeros(1, dtype=np.int64), places[:-1]])  # of the token before, in the same text if the next gram is whole
    owner = np.repeat(np.arange(len(n_tokens)), n_tokens)
    return pa.table(
        {
            "recipe_id": pa.array(row["recipe_ids"], pa.int64()),
            "n_tokens": pa.array(row["n_tokens"], pa.int64()),
            "n_known": pa.array(row["n_known"], pa.int64()),
            "base_score": pa.array(np.array(row["count_logs"]) - n_tokens * math.log10(model.tokens + 0.5 * (v + 1)), pa.float64()),
            "score": pa.array(np.bincount(owner, weights=np.log10(p), minlength=len(n_tokens)), pa.float64()),
        }
    )
