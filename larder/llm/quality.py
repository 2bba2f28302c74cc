"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

The n-grams are taken from two spellings of a text: its words, and the shape of each word (capitals, digits, marks, and
whether the text has already had the word after the same word). Shapes carry over to words never seen in training.

The classifier learns from a bounded sample of labelled dossiers, in one task and in a fixed order. Its weights are one array of
``2 ** bits`` numbers (1 MB), whatever the size of the corpus; each task of the scoring job gets a copy and scores
its dossiers as sparse dot products.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.blocks import freed, pack, unpack
from larder.llm.words import Words, mix

BITS = 18
#: Labelled dossiers that are learnt from, at most: those with the smallest hash of their id.
MAX_EXAMPLES = 8192
EPOCHS = 3
# Per-coordinate rate a / (b + sqrt(sum of squared gradients)), and the weight of the absolute and squared penalty.
RATE, RATE_SHIFT, PENALTY_1, PENALTY_2 = 0.6, 1.0, 0.02, 0.05
_GRAM_SIZES = (1, 2)
_FEATURES = "recipe_id long, good int, features binary"


def fit_quality(
    dossiers: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, bits: int = BITS, epochs: int = EPOCHS
) -> np.ndarray:
    """Weights of a classifier for ``labels.good`` (1 or 0), the last one for the constant term.

    ``dossiers``: ``recipe_id`` and ``text``; ``labels``: ``recipe_id`` and ``good``. Labels without an id or value are left out, of several for one id the smallest
    counts, of several texts the one with the smallest hash, so an example is one id. Of more than ``max_examples`` labelled ids those with the smallest hash are taken; that bounds the
    rows that are broadcast and the one training task. Without examples all weights are 0 and all scores 0.5.
    """
    known = labels.select(F.col("recipe_id").cast("long"), F.col("good").cast("int")).dropna()
    known = known.groupBy("recipe_id").agg(F.min("good").alias("good"))
    sample = known.orderBy(F.xxhash64("recipe_id"), "recipe_id").limit(max_examples)
    texts = dossiers.select(F.col("recipe_id").cast("long"), F.col("text").cast("string"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    chosen = texts.join(F.broadcast(sample), "recipe_id").groupBy("recipe_id").agg(F.first("good").alias("good"), one)
    features = chosen.mapInArrow(partial(_features, bits), _FEATURES)

    def learn(table):
        return _learn(bits, epochs, table)

    learnt = features.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weights binary").first()
    size = (1 << bits) + 1
    return np.frombuffer(learnt["weights"], dtype=np.float32) if learnt else np.zeros(size, dtype=np.float32)


def score_quality(dossiers: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(recipe_id, score)`` for each row of ``dossiers``: the probability that it is good.

    Whole texts are scored. A null or empty text has the score of the constant term. Repeated rows score alike.
    """
    texts = dossiers.select(F.col("recipe_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(partial(_score, texts.sparkSession.sparkContext.broadcast(weights)), "recipe_id long, score double")


def keep_good(dossiers: DataFrame, weights: np.ndarray, least: float = 0.5) -> DataFrame:
    """The rows of ``dossiers``, with all their columns, whose ``text`` scores at least ``least``."""
    model = dossiers.sparkSession.sparkContext.broadcast(weights)
    return dossiers.mapInArrow(partial(_kept, model, least), dossiers.schema)


def _shapes(texts: Words) -> np.ndarray:
    """A number for the shape of each word."""

    def per_word(marks: np.ndarray) -> np.ndarray:
        total = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(marks, out=total[1:])
        return total[texts.ends] - total[texts.starts]

    data = texts.data
    capitals = (data >= 0x41) & (data <= 0x5A)
    digits = (data >= 0x30) & (data <= 0x39)
    small = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    marks = ~(capitals | digits | small)
    last = data[texts.ends - 1].astype(np.uint64)
    shape = np.where(marks[texts.ends - 1], last, 0).astype(np.uint64)
    for part, most in ((capitals, 2), (digits, 1), (small, 2), (marks, 3)):
        shape = shape * np.uint64(most + 1) + np.minimum(per_word(part), most).astype(np.uint64)
    at = texts.window_starts(2)
    pairs, owner = texts.window_hashes(at, 2), texts.texts_of_words()[at]
    order = np.lexsort((at, pairs, owner))
    known = np.zeros(len(shape), dtype=np.uint64)
    same = (pairs[order][1:] == pairs[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    known[at[order[1:][same]] + 1] = 1
    return shape * np.uint64(2) + known


def _grams(texts: Words, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the distinct cells of its n-grams: text number, cell and value; either spelling of a text has norm 1."""
    owner = texts.texts_of_words()
    shapes = mix(_shapes(texts) + np.uint64(1))
    mask = np.uint64((1 << bits) - 1)
    out = []
    for hashes in (texts.hashes, shapes):
        keys = []
        for size in _GRAM_SIZES:
            at = texts.window_starts(size)
            gram = hashes[at]
            for k in range(1, size):
                gram = mix(gram ^ np.uint64(size)) + hashes[at + k]
            cells = mix(gram) >> np.uint64(64 - bits)
            keys.append((owner[at].astype(np.uint64) << np.uint64(bits)) | cells)
        keys, counts = np.unique(np.concatenate(keys), return_counts=True)
        text = (keys >> np.uint64(bits)).astype(np.int64)
        values = np.sqrt(counts.astype(np.float64))
        norms = np.sqrt(np.bincount(text, weights=values * values, minlength=len(texts.counts)))
        out.append((text, keys & mask, values / norms[text]))
    text, cells, values = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort((text.astype(np.uint64) << np.uint64(bits)) | cells, kind="stable")
    text, cells, values = text[order], cells[order], values[order]
    if len(text) == 0:
        return text, cells.astype(np.int64), values
    new = np.ones(len(text), dtype=bool)  # a cell that both spellings hit counts once, with both values
    new[1:] = (text[1:] != text[:-1]) | (cells[1:] != cells[:-1])
    return text[new], cells[new].astype(np.int64), np.add.reduceat(values, np.flatnonzero(new))


def _features(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 200):
            part = batch.slice(low, 200)
            text, cells, values = _grams(Words(part.column("text")), bits)
            at = np.searchsorted(text, np.arange(part.num_rows + 1))
            scaled = np.round(values * (1 << 16)).astype(np.uint64)
            packed = [pack(cells[a:b], scaled[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("recipe_id"), part.column("good"), pa.array(packed, pa.binary())], ["recipe_id", "good", "features"]
            )


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def _learn(bits: int, epochs: int, table: pa.Table) -> pa.Table:
    """One pass over the examples per epoch, each example in the order of a hash of its id."""
    table = table.sort_by([("recipe_id", "ascending")])
    rows = sorted(
        zip(table["recipe_id"].to_pylist(), table["good"].to_pylist(), table["features"].to_pylist(), strict=True),
        key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) & ((1 << 64) - 1), r[1], r[2]),
    )
    examples = []
    for _, good, features in rows:
        cells, values = unpack(features)
        cells = np.append(cells.astype(np.int64), 1 << bits)
        examples.append((cells, np.append(values / (1 << 16), 0.2), good))
    size = (1 << bits) + 1
    pull, squares = np.zeros(size), np.zeros(size)

    def weights(cells):
        z, n = pull[cells], squares[cells]
        rate = (RATE_SHIFT + np.sqrt(n)) / RATE + PENALTY_2
        return np.where(np.abs(z) <= PENALTY_1, 0.0, -(z - np.sign(z) * PENALTY_1) / rate)

    for _ in range(epochs):
        for cells, values, good in examples:
            w = weights(cells)
            gradient = (_sigmoid(w @ values) - good) * values
            more = squares[cells] + gradient * gradient
            pull[cells] += gradient - (np.sqrt(more) - np.sqrt(squares[cells])) / RATE * w
            squares[cells] = more
    final = weights(np.arange(size)).astype(np.float32)
    return pa.table({"weights": pa.array([final.tobytes()], pa.binary())})


def _scores(w: np.ndarray, texts: pa.Array) -> np.ndarray:
    bits = (len(w) - 1).bit_length() - 1
    out = [np.zeros(0)]
    for low in range(0, len(texts), 200):
        part = texts.slice(low, 200)
        text, cells, values = _grams(Words(part), bits)
        out.append(_sigmoid(np.bincount(text, weights=values * w[cells], minlength=len(part)) + 0.2 * w[-1]))
    return np.concatenate(out)


def _score(weights, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = weights.value.astype(np.float64)
    for batch in batches:
        scores = pa.array(_scores(w, batch.column("text")), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("recipe_id"), scores], ["recipe_id", "score"])


def _kept(weights, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w = weights.value.astype(np.float64)
    for batch in batches:
        yield batch.filter(pa.array(_scores(w, batch.column("text")) >= least))
    freed()
