import random

import numpy as np
from pyspark.sql import functions as F

from larder.llm.quality import fit_quality, keep_good, score_quality

DOCS, LABELS = "recipe_id long, text string", "recipe_id long, good int"


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abdelmnorst", k=rng.randint(2, 9)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        good = k % 4 != 0
        if not good:
            kind = rng.randint(0, 2)
            words = [[w.upper() + "!!" for w in words], [words[0]] * len(words), [f"{w} |" for w in words]][kind]
        rows.append((k, " ".join(words), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i % 3], LABELS)
    weights = fit_quality(docs, labels)
    scores = {r.recipe_id: r.score for r in score_quality(docs, weights).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    right = [(scores[i] >= 0.5) == (g == 1) for i, _, g in rows if i % 3 == 0]
    assert np.mean(right) > 0.95
    again = fit_quality(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(weights, again)
    kept = keep_good(docs.selectExpr("recipe_id as doc_id", "text", "1 as score"), weights)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.5} and kept.columns == ["doc_id", "text", "score"]


def test_sample_is_bounded_and_odd_rows_are_scored(spark):
    rows = corpus(60, 2) + [(100, None, 1), (101, "", 0), (None, "x", 1), (5, "doppelt", 1), (102, "lang " * 50000, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, g) for i, _, g in rows] + [(7, None), (None, 0), (999, 1), (3, 0)], LABELS)
    got = score_quality(docs, fit_quality(docs, labels, max_examples=20)).collect()
    assert len(got) == len(rows)
    empty = {r.score for r in got if r.recipe_id in (100, 101)}
    assert len(empty) == 1


def test_without_labels_all_scores_are_even(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert [r.score for r in score_quality(docs, fit_quality(docs, labels)).collect()] == [0.5, 0.5]
    assert score_quality(docs.limit(0), fit_quality(docs.limit(0), labels)).count() == 0


def test_copies_of_an_id_count_as_one_example(spark):
    others = spark.createDataFrame([(8, "GROB !!"), (9, "nett")], DOCS)
    copies = spark.range(0, 3000).selectExpr("7L as recipe_id", "concat('x ', id % 3) as text")
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 1)], LABELS)
    one = copies.orderBy(F.xxhash64("text")).limit(1)
    assert np.array_equal(fit_quality(copies.unionByName(others), labels), fit_quality(one.unionByName(others), labels))
