import random
import re

from larder.llm.leaks import mark_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, size):
    out = []
    for i, text in docs:
        ws = words(text)
        hit, ids = set(), set()
        for item, t in items:
            iw = words(t)
            n = min(size, len(iw))
            if item is None or not iw:
                continue
            wanted = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in wanted:
                    hit.update(range(k, k + n))
                    ids.add(str(item))
        out.append((i, len(ws), len(hit), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "recipe_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = mark_leaks(d, b, **more).select("recipe_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_every_shared_window_is_found(spark):
    rng = random.Random(11)
    vocabulary = ["Rüben", "salz", "ÖL", "reis", "9", "mehl", "日本"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(k % 25, say(rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 14, 30]))) for k in range(30)]
    items += [(None, say(12)), (77, None), (78, " .,"), (79, "reis " * 30)]
    docs = [(k, " x ".join(rng.choice([say(rng.randint(0, 25)), rng.choice(items)[1] or ""]) for _ in range(4))) for k in range(80)]
    docs += [(None, items[3][1]), (5, items[4][1]), (5, items[4][1]), (90, None), (91, ""), (92, "reis " * 2000)]
    long_items = [(i, t) for i, t in items if len(words(t)) >= 8]
    assert run(spark, docs, items) == brute(docs, items, 10)
    assert run(spark, docs, long_items) == brute(docs, long_items, 10)


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, [], False)]
    d = spark.createDataFrame([(1, "A b, c", 5, "z")], "recipe_id long, text string, size int, words string")
    b = spark.createDataFrame([(2, "a B c", "q")], "item_id long, text string, recipe_id string")
    assert mark_leaks(d, b).select("n_hit", "item_ids").collect() == [(3, ["2"])]


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("larder.llm.leaks.MAX_BROADCAST_ROWS", 0)
    docs, items = [(1, "a b c d e f g h i j k"), (2, "a b")], [(9, "x a b c d e f g h i j y")]
    assert run(spark, docs, items) == brute(docs, items, 10)
