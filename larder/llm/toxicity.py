"""Toxicity of dossiers: embeddings of character n-grams, averaged, under a linear softmax.

A word is the mean of the vectors of its character n-grams (3 to 6 characters, its borders included) and of itself as a whole,
a text the mean of its words, and a softmax over two classes reads the text. Vectors and softmax are trained together, so a
misspelt or inflected word that training never saw has the vectors of the n-grams that it shares with known words.

The vectors lie in ``2 ** bits`` hashed rows of ``DIM`` numbers. Training takes a bounded sample of labelled dossiers, in one
task and in a fixed order. Scoring reads every text: as the model is linear up to the softmax, each row is reduced to what it
adds to the margin between the classes (``2 ** bits`` numbers, 1 MB), and that is what tasks get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.words import Words, mix

BITS, DIM = 16, 8
SHORTEST, LONGEST = 3, 5
#: Labelled dossiers that are learnt from, at most: those with the smallest hash of their id.
MAX_EXAMPLES = 8192
EPOCHS, BATCH = 6, 16
#: Batches at least: a small sample is gone through more often.
STEPS = 1500
#: Rate of the first epoch (it falls to a tenth of it) start of the sums of squares, and decay of all vectors with each batch.
RATE, SQUARES, DECAY = 3.0, 1e-3, 1e-4
#: Texts that are split into words at once.
_ROWS = 256
_FEATURES = "recipe_id long, toxic int, words binary, counts binary, grams binary"


@dataclass(frozen=True)
class ToxicityModel:
    """Vectors of the hashed n-grams, and weights and constant terms of the two classes (not toxic, toxic)."""

    vectors: np.ndarray
    classes: np.ndarray
    constants: np.ndarray

    def margins(self) -> np.ndarray:
        """What each hashed n-gram adds to the margin of the toxic class, and the constant margin at the end."""
        rows = self.vectors @ (self.classes[1] - self.classes[0])
        return np.append(rows, self.constants[1] - self.constants[0]).astype(np.float32)


def fit_toxicity(
    dossiers: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, bits: int = BITS, epochs: int = EPOCHS, steps: int = STEPS
) -> ToxicityModel:
    """A model of ``labels.toxic`` (1 or 0).

    ``dossiers``: ``recipe_id`` and ``text``; ``labels``: ``recipe_id`` and ``toxic``; other columns do not matter. Labels without an id or value
    are left out; of several for one id the largest counts, of several texts the one with the smallest hash, so an example is one id.
    Of more than ``max_examples`` labelled ids those with the smallest hash are taken; that bounds what is broadcast and
    the one training task, whatever the size of the corpus. Without examples the model gives 0.5 to every text.
    """
    known = labels.select(F.col("recipe_id").cast("long"), F.col("toxic").cast("int")).dropna()
    known = known.groupBy("recipe_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("recipe_id"), "recipe_id").limit(max_examples)
    texts = dossiers.select(F.col("recipe_id").cast("long"), F.col("text").cast("string"))
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    chosen = texts.join(F.broadcast(sample), "recipe_id").groupBy("recipe_id").agg(F.first("toxic").alias("toxic"), one)
    features = chosen.mapInArrow(partial(_features, bits), _FEATURES)

    def learn(table):
        return _learn(bits, epochs, steps, table)

    learnt = features.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "vectors binary, classes binary").first()
    if learnt is None:
        return ToxicityModel(np.zeros((1 << bits, DIM), np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32))
    classes = np.frombuffer(learnt["classes"], np.float32).reshape(2, DIM + 1)
    return ToxicityModel(np.frombuffer(learnt["vectors"], np.float32).reshape(-1, DIM), classes[:, :DIM], classes[:, DIM])


def score_toxicity(dossiers: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(recipe_id, score)`` for each row of ``dossiers``: the probability that its text is toxic.

    Whole texts are scored. A text without words, a null one too, has the score of the constant terms. Repeated rows score alike;
    rows without an id keep a null id; no rows give no rows.
    """
    texts = dossiers.select(F.col("recipe_id").cast("long"), F.col("text").cast("string"))
    margins = texts.sparkSession.sparkContext.broadcast(model.margins())
    return texts.mapInArrow(partial(_score, margins), "recipe_id long, score double")


def _grams(texts: Words, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the given word numbers: row of each n-gram, the place of its word in ``words``, and n-grams of each word."""
    data = texts.data.tobytes()
    joined = b" ".join([b"", *(data[a:b] for a, b in zip(texts.starts[words], texts.ends[words], strict=True)), b""])
    # white space beyond ASCII can come up inside a word; only the blanks put in here may part words
    codes = np.frombuffer(joined.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    borders = np.flatnonzero(codes == 0x20)
    sizes = np.diff(borders) + 1
    owner = np.repeat(np.arange(len(words)), sizes - 1)
    left = borders[1:][owner] + 1 - np.arange(len(owner))  # codes from here to the border behind the word
    spread = mix(codes.astype(np.uint64) + np.uint64(1))
    state, rows, owners = np.zeros(len(owner), dtype=np.uint64), [], []
    at = np.arange(len(owner))
    for size in range(1, LONGEST + 1):
        at = at[left[at] >= size]
        state[at] = state[at] * np.uint64(0x9E3779B97F4A7C15) + spread[at + size - 1]
        if size >= SHORTEST:
            rows.append(mix(state[at] ^ np.uint64(size)) >> np.uint64(64 - bits))
            owners.append(owner[at])
    # the word as a whole, under a hash of its own
    rows.append(mix(texts.hashes[words] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(64 - bits))
    owners.append(np.arange(len(words)))
    rows, owners = np.concatenate(rows).astype(np.int64), np.concatenate(owners)
    return rows, owners, np.bincount(owners, minlength=len(words))


def _vocabulary(texts: Words) -> tuple[np.ndarray, np.ndarray]:
    """The number of one occurrence of each different word, and for each occurrence the place of its word there."""
    _, first, which = np.unique(texts.hashes, return_index=True, return_inverse=True)
    return first, which


def _features(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its different words and how often it has them; without an id, the rows of the n-grams of all words of a batch."""
    for batch in batches:
        for low in range(0, batch.num_rows, _ROWS):
            part = batch.slice(low, _ROWS)
            texts = Words(part.column("text"), lower=True)
            words, which = _vocabulary(texts)
            rows, owners, sizes = _grams(texts, words, bits)
            hashes = texts.hashes[words]
            own = [np.unique(which[a:b], return_counts=True) for a, b in zip(texts.first[:-1], texts.first[1:], strict=True)]
            columns = [
                pa.array([*part.column("recipe_id").to_pylist(), None], pa.int64()),
                pa.array([*part.column("toxic").to_pylist(), None], pa.int32()),
                pa.array([*(hashes[w].tobytes() for w, _ in own), hashes.tobytes()], pa.binary()),
                pa.array([*(_short(n) for _, n in own), _short(sizes)], pa.binary()),
                pa.array([*(None for _ in own), _short(rows[np.argsort(owners, kind="stable")])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["recipe_id", "toxic", "words", "counts", "grams"])


def _short(numbers: np.ndarray) -> bytes:
    return numbers.astype(np.uint32).tobytes()


def _joined(values: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind).astype(np.int64 if kind is np.uint32 else kind)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _learn(bits: int, epochs: int, steps: int, table: pa.Table) -> pa.Table:
    """Descent in small batches, each row with a rate of its own; examples in the order of a hash of their ids."""
    of_words = table.filter(pa.compute.is_null(table["recipe_id"]))
    hashes, sizes = _joined(of_words["words"].to_pylist(), np.uint64), _joined(of_words["counts"].to_pylist(), np.uint32)
    grams, begins = _joined(of_words["grams"].to_pylist(), np.uint32), np.cumsum(sizes) - sizes
    hashes, first = np.unique(hashes, return_index=True)
    begins, sizes = begins[first], sizes[first]
    docs = table.filter(pa.compute.is_valid(table["recipe_id"]))
    docs = docs.take(pa.array(np.argsort(mix(docs["recipe_id"].to_numpy().astype(np.uint64)))))
    toxic = (docs["toxic"].to_numpy() > 0).astype(np.int64)
    words = [np.searchsorted(hashes, np.frombuffer(w, np.uint64)) for w in docs["words"].to_pylist()]
    shares = [np.frombuffer(n, np.uint32) / max(1, np.frombuffer(n, np.uint32).sum()) for n in docs["counts"].to_pylist()]

    epochs = max(epochs, -(-steps * BATCH // max(1, len(words))))
    rng = np.random.default_rng(0)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << bits, DIM)).astype(np.float32)
    squares = np.full(1 << bits, SQUARES)
    # one more weight for a constant input of 1
    classes, class_squares = rng.uniform(-1 / DIM, 1 / DIM, (2, DIM + 1)), np.full((2, DIM + 1), SQUARES)
    classes[:, DIM] = 0
    for epoch in range(epochs):
        rate = RATE * (1 - 0.9 * epoch / max(1, epochs - 1))
        for low in range(0, len(words), BATCH):
            part, share = words[low : low + BATCH], np.concatenate(shares[low : low + BATCH])
            lengths = [len(w) for w in part]
            known, place = np.unique(np.concatenate(part), return_inverse=True)
            rows, each = grams[_ranges(begins[known], sizes[known])], sizes[known]
            means = np.ones((len(part), DIM + 1))
            if len(known):
                taken = np.concatenate([[0], np.cumsum(each)[:-1]])
                of_word = np.add.reduceat(np.take(vectors, rows, axis=0), taken, axis=0) / each[:, None]
            owner = np.repeat(np.arange(len(part)), lengths)
            for d in range(DIM):
                weights = share * of_word[place, d] if len(known) else share
                means[:, d] = np.bincount(owner, weights=weights, minlength=len(part))
            error = _softmax(means @ classes.T)
            error[np.arange(len(part)), toxic[low : low + BATCH]] -= 1
            # for two classes the gradient of a text's mean is its error times the difference of the class weights
            pull = np.bincount(place, weights=share * error[owner, 1], minlength=len(known)) / each
            pull = np.bincount(rows, weights=np.repeat(pull, each), minlength=1 << bits)
            along = classes[1, :DIM] - classes[0, :DIM]
            squares += pull * pull * (along @ along) / DIM
            # whole arrays: faster than to pick and put back the rows that are used
            vectors *= np.float32(1 - rate * DECAY)
            vectors -= np.multiply.outer((rate * pull / np.sqrt(squares)).astype(np.float32), along.astype(np.float32))
            slope = error.T @ means / len(part)
            class_squares += slope * slope
            classes -= rate * slope / np.sqrt(class_squares)
    return pa.table(
        {
            "vectors": pa.array([vectors.tobytes()], pa.binary()),
            "classes": pa.array([classes.astype(np.float32).tobytes()], pa.binary()),
        }
    )


def _scores(margins: np.ndarray, column: pa.Array) -> np.ndarray:
    bits, out = (len(margins) - 1).bit_length() - 1, [np.zeros(0)]
    for low in range(0, len(column), _ROWS):
        texts = Words(column.slice(low, _ROWS), lower=True)
        words, which = _vocabulary(texts)
        rows, owners, sizes = _grams(texts, words, bits)
        each = np.bincount(owners, weights=margins[rows], minlength=len(words)) / np.maximum(1, sizes)
        total = np.bincount(texts.texts_of_words(), weights=each[which], minlength=len(texts.counts))
        margin = total / np.maximum(1, texts.counts) + margins[-1]
        out.append(1.0 / (1.0 + np.exp(-np.clip(margin, -35.0, 35.0))))
    return np.concatenate(out)


def _score(margins, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = margins.value.astype(np.float64)
    for batch in batches:
        scores = pa.array(_scores(held, batch.column("text")), pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column("recipe_id"), scores], ["recipe_id", "score"])
