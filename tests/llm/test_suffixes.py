import random

import numpy as np
import pyarrow as pa

from larder.llm.suffixes import minimisers, repeated_passages
from larder.llm.words import Words


def brute(rows, words):
    rank = lambda i: float("inf") if i is None else i
    first = {}
    split = [(i, (t or "").split(), t or "") for i, t in rows]
    for i, ws, _ in split:
        for k in range(len(ws) - words + 1):
            key = tuple(ws[k : k + words])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, ws, _ in split:
        gone = {}
        for k in range(len(ws) - words + 1):
            f = first[tuple(ws[k : k + words])]
            if f < rank(i):
                for j in range(k, k + words):
                    gone.setdefault(j, []).append(f)
        spans, k = [], 0
        while k < len(ws):
            if k not in gone:
                k += 1
                continue
            low, seen = k, []
            while k in gone:
                seen += gone[k]
                k += 1
            spans.append((low, k - low, min(seen)))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), spans, kept if spans else None))
    return sorted(out, key=repr)


def run(spark, rows, words, gram, **more):
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    got = []
    for r in repeated_passages(df, words, gram, **more).collect():
        kept = None if r.kept_text is None else r.kept_text.split()
        got.append((r.recipe_id, r.n_words, r.n_repeated, [(s.start, s.size, s.first_recipe_id) for s in r.spans], kept))
    return sorted(got, key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = ["rüebli", "lauch", "salz,", "Salz", "öl", "reis", "mehl", "日本", "x", "y"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(10, 40))) for _ in range(8)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages).split()
            low = rng.randint(0, len(p) // 2)
            parts.append(" ".join(p[low : rng.randint(low, len(p))]) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 20))))
        rows.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", "\n", "\t"]).join(parts)))
    rows += [(500 + i, passages[0] + " " + passages[1]) for i in range(40)]
    rows += [(600 + i, f"{i} {passages[2]} {i * i}") for i in range(60)]
    return rows + [(900, None), (901, ""), (902, "reis " * 200), (903, "reis " * 200)]


def test_passages_against_brute_force(spark):
    rows = rows_of(4)
    assert run(spark, rows, 8, 3) == brute(rows, 8)
    assert run(spark, rows, 8, 3, block_bytes=600, hot=20) == brute(rows, 8)


def test_full_size_and_empty(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(str(rng.randint(0, 400)) for _ in range(n))
    shared = say(55)
    rows = [(i, f"{say(rng.randint(0, 90))} {shared} {say(30)}") for i in range(30)] + [(40, say(49)), (41, say(3000))]
    assert run(spark, rows, 50, 10) == brute(rows, 50)
    assert run(spark, rows, 50, 10, hot=3, block_bytes=2000) == brute(rows, 50)
    assert run(spark, [], 50, 10) == []


def test_every_window_has_a_minimiser_chosen_by_content():
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 50, 800)))
    texts = Words(pa.array([text, "a b", text[4:]]))
    at, _ = minimisers(texts, 20, 5)
    ws = set(at.tolist())
    for s in texts.window_starts(20):
        assert any(p in ws for p in range(s, s + 16))
    inside = [p for p in at if p >= texts.first[2] + 20]
    shift = texts.first[2] - (texts.counts[0] - texts.counts[2])
    assert all(p - shift in ws for p in inside)
