import hashlib
import random

import pytest

from larder.llm.steptrie import grow_trie, number_steps, step_trie

STEPS = "recipe_id long, step_no long, section string, text string"


def brute(ids, steps, fields=lambda s: (s[2] or "", s[3] or "")):
    walks = {i: [] for i in ids if i is not None}
    for s in sorted(steps, key=lambda s: (s[1] is not None, s[1] or 0)):
        if s[0] in walks:
            walks[s[0]].append((fields(s), len((s[3] or "").encode())))
    members, ends = {}, {}
    for i, walk in walks.items():
        for d in range(len(walk) + 1):
            members.setdefault(tuple(walk[:d]), []).append(i)
        ends.setdefault(tuple(walk), []).append(i)
    kids, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * node[-1][1] if node else 0
        saved[node] = saved.get(node, 0) + own
        leaves[node] = leaves.get(node, 0) or 1
        if node:
            for table, value in ((kids, 1), (leaves, leaves[node]), (saved, saved[node])):
                table[node[:-1]] = table.get(node[:-1], 0) + value
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), kids.get(n, 0), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def kitchen(seed, recipes=160, longest=12):
    """Recipes that share beginnings: each goes on from a random earlier one."""
    rng = random.Random(seed)
    walks = [[]]
    for _ in range(recipes):
        old = rng.choice(walks)
        walks.append(old[: rng.randint(0, len(old))] + [rng.choice(["Rühren", "Backen", "", "Ruhen lassen"]) for _ in range(rng.randint(0, 4))])
        walks[-1] = walks[-1][:longest]
    ids = rng.sample(range(10_000), len(walks))
    return ids, [(i, 2 * k, rng.choice(["a", None]) if k > 6 else None, t) for i, w in zip(ids, walks, strict=True) for k, t in enumerate(w)]


@pytest.mark.parametrize(
    "sizes",
    [
        {},
        {"most_suffixes": 8, "shard_bytes": 200},
        {"segment": 3, "most_suffixes": 10},
        {"segment": 1, "most_suffixes": 1},
        {"segment": 4, "most_bytes": 100, "shard_bytes": 1},
    ],
)
def test_equals_brute_force(spark, sizes):
    ids, steps = kitchen(len(sizes))
    recipes = spark.createDataFrame([(i,) for i in ids], "recipe_id long")
    placed = number_steps(spark.createDataFrame(steps, STEPS), ("section", "text"))
    assert rows(grow_trie(recipes, placed, **sizes)) == brute(ids, steps)


def test_long_shared_beginning_is_burst_once(spark):
    # 300 recipes with 40 steps in common, of which most are copies: the beginning is one chain
    steps = [(i, k, None, f"Schritt {k}") for i in range(1, 301) for k in range(40)]
    steps += [(i, 40, None, f"Variante {i % 7 if i < 200 else i}") for i in range(1, 301)]
    ids = range(1, 301)
    recipes = spark.createDataFrame([(i,) for i in ids], "recipe_id long")
    placed = number_steps(spark.createDataFrame(steps, STEPS), ("section", "text"))
    assert rows(grow_trie(recipes, placed, most_suffixes=20)) == brute(ids, steps)


def test_a_very_long_recipe_is_cut_into_segments(spark):
    steps = [(7, k, None, "x" * (k % 5)) for k in range(60)] + [(9, k, None, "x" * (k % 5)) for k in range(30)] + [(8, 0, None, "y" * 70000)]
    recipes = spark.createDataFrame([(7,), (8,), (9,)], "recipe_id long")
    placed = number_steps(spark.createDataFrame(steps, STEPS), ("section", "text"))
    assert rows(grow_trie(recipes, placed, segment=10)) == brute([7, 8, 9], steps)


def test_nulls_repeats_unknown_recipes_and_clashing_columns(spark):
    steps = [(1, None, None, None), (1, 3, "b", "Kochen"), (2, 1, None, ""), (2, 2, "b", "Kochen"), (None, 1, "b", "Kochen"), (99, 1, "b", "Kochen")]
    df = spark.createDataFrame([(*s, 5, "z") for s in steps], STEPS + ", depth long, head string")
    recipes = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "d")], "id int, seq string")
    got = step_trie(recipes, df, ("section", "text"))
    assert rows(got) == brute([1, 2, 3], steps)
    # by text alone, sections do not matter
    assert rows(step_trie(recipes, df)) == brute([1, 2, 3], steps, lambda s: s[3] or "")


def test_no_recipes(spark):
    none = step_trie(spark.createDataFrame([], "id int"), spark.createDataFrame([], STEPS))
    assert none.count() == 0 and none.columns[-1] == "ends_sha256"
    only = step_trie(spark.createDataFrame([(4,)], "id int"), spark.createDataFrame([], STEPS))
    assert rows(only) == brute([4], [])
