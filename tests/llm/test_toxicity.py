import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm.toxicity import LONGEST, SHORTEST, _grams, _scores, _vocabulary, fit_toxicity, score_toxicity
from larder.llm.words import Words, mix

DOCS, LABELS = "recipe_id long, text string", "recipe_id long, toxic int"


def corpus(n, seed):
    """Every fourth text holds inflected forms of an insult; the forms of held-out texts are all different."""
    rng = random.Random(seed)
    make = lambda: "".join(rng.choices("abdeimnorsty", k=rng.randint(2, 9)))
    usual = [make() for _ in range(400)]
    word = lambda: rng.choice(usual) if rng.random() < 0.9 else make()
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 90))]
        if k % 4 == 0:
            for _ in range(1 + len(words) // 25):
                words[rng.randrange(len(words))] = "grumpf" + make()
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    return rows


def test_unseen_spellings_are_recognised(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i % 3], LABELS)
    model = fit_toxicity(docs, labels)
    scores = {r.recipe_id: r.score for r in score_toxicity(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert np.mean([(scores[i] >= 0.5) == (t == 1) for i, _, t in rows if i % 3 == 0]) > 0.9
    again = fit_toxicity(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.classes, again.classes)
    # reducing the vectors to margins changes nothing: the softmax over the mean vector gives the same
    text = rows[3][1]
    words = Words(pa.array([text]), lower=True)
    different, which = _vocabulary(words)
    grams, owners, sizes = _grams(words, different, 16)
    vectors = np.zeros((len(different), model.vectors.shape[1]))
    np.add.at(vectors, owners, model.vectors[grams])
    mean = (vectors / sizes[:, None])[which].mean(axis=0)
    z = model.classes @ mean + model.constants
    assert scores[3] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-5)


def test_grams_equal_brute_force():
    texts = ["Ei äÖ ei", "", None, "straße\t　x" + "y" * 20, "ab"]
    words = Words(pa.array(texts, pa.string()), lower=True)
    different, which = _vocabulary(words)
    grams, owners, sizes = _grams(words, different, 64 - 1)

    def state(piece):
        value = 0
        for c in piece:
            value = (value * 0x9E3779B97F4A7C15 + int(mix(np.array([ord(c) + 1], np.uint64))[0])) % (1 << 64)
        return int(mix(np.array([value ^ len(piece)], np.uint64))[0]) >> 1

    data = words.data.tobytes()
    for k, at in enumerate(different):
        word = f" {data[words.starts[at] : words.ends[at]].decode().lower()} "
        want = sorted(state(word[i : i + n]) for n in range(SHORTEST, LONGEST + 1) for i in range(len(word) - n + 1))
        have = grams[owners == k]
        assert sorted(have[:-1].tolist()) == want and sizes[k] == len(want) + 1


def test_sample_is_bounded_and_odd_rows_are_scored(spark):
    rows = corpus(60, 2) + [(100, None, 1), (101, "", 0), (None, "x", 1), (5, "doppelt", 1), (102, "lang " * 50000, 1), (103, " \n", 0)]
    docs = spark.createDataFrame([(*r[:2], 7, "z") for r in rows], DOCS + ", toxic int, words string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(7, None), (None, 0), (999, 1), (3, 0)], LABELS)
    got = score_toxicity(docs, fit_toxicity(docs, labels, max_examples=20)).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.recipe_id in (100, 101, 103)}) == 1
    assert all(0 <= s <= 1 for s in _scores(np.zeros((1 << 16) + 1), pa.array(["a", None])))


def test_copies_of_an_id_count_as_one_example(spark):
    others = spark.createDataFrame([(8, "grob"), (9, "nett")], DOCS)
    copies = spark.range(0, 3000).selectExpr("7L as recipe_id", "concat('x ', id % 3) as text")
    labels = spark.createDataFrame([(7, 0), (8, 1), (9, 0)], LABELS)
    model = fit_toxicity(copies.unionByName(others), labels)
    one = copies.orderBy(F.xxhash64("text")).limit(1)
    assert np.array_equal(model.vectors, fit_toxicity(one.unionByName(others), labels).vectors)


def test_without_labels_all_scores_are_even(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert [r.score for r in score_toxicity(docs, fit_toxicity(docs, labels)).collect()] == [0.5, 0.5]
    assert score_toxicity(docs.limit(0), fit_toxicity(docs.limit(0), labels)).count() == 0
