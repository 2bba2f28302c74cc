import random

import pytest

from larder.llm.substrings import drop_repeated_passages
from larder.llm.words import Words
import pyarrow as pa


def brute(rows, words):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - words + 1):
            key = tuple(ws[k : k + words])
            rank = float("inf") if i is None else i
            first[key] = min(first.get(key, rank), rank)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - words + 1):
            if first[tuple(ws[k : k + words])] < (float("inf") if i is None else i):
                gone.update(range(k, k + words))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()
        out.append((i, len(ws), len(gone), kept))
    return sorted(out, key=repr)


def run(spark, rows, words, **more):
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    return sorted((tuple(r) for r in drop_repeated_passages(df, words, **more).collect()), key=repr)


def test_windows_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["rüebli", "lauch", "salz,", "Salz", "öl", "reis", "mehl", "日本"]
    passages = [" ".join(rng.choices(vocabulary, k=9)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice([*passages, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))]) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, None, 7]), rng.choice(["  ", "\n", "\t"]).join(parts)))
    rows += [(500 + i, passages[0] + " " + passages[1]) for i in range(60)]  # a hot group of copies
    rows += [(900, None), (901, ""), (902, "\n "), (903, "kurz")]
    assert run(spark, rows, 4) == brute(rows, 4)
    assert run(spark, rows, 4, block_bytes=300) == brute(rows, 4)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"wort{i % 5000}" for i in range(60000))
    rows = [(1, "a b c d e"), (2, long), (3, "x " + long), (4, "y" * 400_000)]
    assert run(spark, rows, 13) == brute(rows, 13)
    assert run(spark, [], 13) == []


def test_clashing_columns_are_ignored(spark):
    rows = [(1, "a b c d", 9, "x"), (2, "a b c d", 9, "x")]
    df = spark.createDataFrame(rows, "recipe_id long, text string, block int, payload string")
    got = sorted(tuple(r) for r in drop_repeated_passages(df, 3).collect())
    assert got == [(1, 4, 0, "a b c d"), (2, 4, 4, "")]


@pytest.mark.parametrize("texts", [["a b", None, "", "c"], ["ab", "cd"], []])
def test_words_end_with_their_text(texts):
    words = Words(pa.array(texts, pa.string()))
    assert words.counts.tolist() == [len((t or "").split()) for t in texts]
