import math
import random
from collections import Counter

import numpy as np

from larder.llm.nearcopies import common_weights, near_copies, samples


def brute(rows, size=5, threshold=0.8):
    sets = []
    for _, text in rows:
        ws = (text or "").split()
        grams = [tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)] or ([tuple(ws)] if ws else [])
        sets.append(Counter(grams))
    df = Counter(g for s in sets for g in s)
    n = len(rows)
    idf = {g: 1 + (math.log(n / max(c, 2)) / math.log(n) if n > 1 else 0) for g, c in df.items()}
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            low = sum(min(c, sets[b][g]) * idf[g] for g, c in sets[a].items())
            high = sum(c * idf[g] for s in (sets[a], sets[b]) for g, c in s.items()) - low
            if low >= (threshold - 1e-9) * high:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    first = {}
    for k in range(n):
        if rows[k][0] is not None:
            first[find(k)] = min(first.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((i, None if i is None else first[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    return sorted((tuple(r) for r in near_copies(df, **more).collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    rows = []
    for base in range(12):
        words = say(rng.randint(30, 300))
        for _ in range(rng.randint(1, 8)):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            rows.append(" ".join(copy))
    hot = say(120)  # a third of all rows: copies and near copies of one text
    for k in range(40):
        copy = list(hot)
        if k % 2:
            copy[rng.randrange(120)] = f"h{k}"
        rows.append(" ".join(copy))
    loose = say(150)  # copies of which only some pairs reach the threshold
    for _ in range(60):
        copy = list(loose)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(150)] = f"l{rng.randint(0, 10**6)}"
        rows.append(" ".join(copy))
    rows += [" ".join(say(4)), "a b", "a b", "a  b\n", "", None, "", "reis " * 500, "reis " * 470, "reis " * 90]
    ids = list(range(100, 100 + len(rows)))
    rng.shuffle(ids)
    return [*zip(ids, rows, strict=True), (None, "a b"), (ids[0], rows[0])]


def test_classes_against_brute_force(spark):
    rows = corpus(2)
    assert run(spark, rows, block_bytes=20_000) == brute(rows)


def test_large_buckets_are_compared_part_by_part(spark, monkeypatch):
    monkeypatch.setattr("larder.llm.nearcopies.PART_NODES", 7)
    rows = corpus(5)
    assert run(spark, rows) == brute(rows)


def test_common_weights():
    rng = np.random.default_rng(4)
    idf = rng.random(60) + 1
    counts = rng.integers(0, 4, (9, 60)) * rng.integers(0, 9, (9, 60))
    cells = np.arange(60).astype(np.uint64)
    got = common_weights([(cells[c > 0], c[c > 0].astype(np.uint64), idf[c > 0]) for c in counts])
    for a in range(9):
        for b in range(a):
            assert abs(got[a, b] - (np.minimum(counts[a], counts[b]) * idf).sum()) < 1e-9


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(4, "a b c", 1, "x"), (2, "a b c", 1, "x")], "recipe_id long, text string, node int, band string")
    assert sorted(near_copies(df).collect()) == [(2, 2), (4, 2)]


def test_samples_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    cells = np.sort(rng.integers(0, 1 << 40, 400).astype(np.uint64))
    one, two = rng.integers(1, 5, 400) * 1.3, rng.integers(1, 5, 400) * 1.3
    two[:80], one[300:] = 0, 0
    true = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    drawn = [samples(np.zeros((w > 0).sum(), dtype=np.int64), cells[w > 0], w[w > 0], 4000)[0] for w in (one, two)]
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.03
