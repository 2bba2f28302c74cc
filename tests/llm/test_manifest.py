import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm.manifest import build_manifest, check_dossiers
from larder.llm.midstates import as_bytes, hash_children, resume, start

DOSSIERS = "recipe_id long, source string, language string, n_chars long, text string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(tree, places):
    """Root of a list of digests, and for each place the siblings and the way up as (digests, place) per level."""
    ways = {p: [] for p in places}
    at = {p: p for p in places}
    while len(tree) > 1:
        for p in places:
            low = at[p] // 16 * 16
            ways[p].append((tree[low : low + 16], at[p] % 16))
            at[p] //= 16
        tree = [sha(tree[k : k + 16]) for k in range(0, len(tree), 16)]
    return tree[0], ways


def brute(rows, changed):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    first = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))
    trees = {s: sorted(sources[s], key=first) for s in names}
    subs, ways = {}, {}
    for s in names:
        subs[s], ways[s] = climb([leaf_of(r) for r in trees[s]], range(len(trees[s])))
    root, up = climb([subs[s] for s in names], range(len(names)))
    out = []
    for k, s in enumerate(names):
        for p, row in enumerate(trees[s]):
            way = ways[s][p] + up[k]
            value = leaf_of(changed(row))
            for digests, slot in way:
                value = sha(digests[:slot] + [value] + digests[slot + 1 :])
            proof = sha(d for digests, slot in way for j, d in enumerate(digests) if j != slot)
            out.append((row[0], leaf_of(row), subs[s], root, proof, value, value == root))
    return sorted(out, key=repr)


def lowered(row):
    text = row[4] if row[4] is None or (row[0] or 1) % 5 else row[4].lower()
    return (*row[:4], text)


def check(spark, rows):
    df = spark.createDataFrame(rows, DOSSIERS).withColumn("tree", F.lit(1)).withColumn("position", F.lit("x"))
    text = F.when(F.coalesce(F.when(F.col("recipe_id") == 0, 1).otherwise(F.col("recipe_id")), F.lit(1)) % 5 != 0, F.col("text")).otherwise(F.lower("text"))
    got = [tuple(r) for r in check_dossiers(build_manifest(df, text)).collect()]
    assert sorted(got, key=repr) == brute(rows, lowered)


def test_midstates_equal_hashlib():
    rng = np.random.default_rng(1)
    counts = np.array([1, 16, 5, 2, 16])
    digests = rng.integers(0, 256, (counts.sum(), 32), dtype=np.uint8)
    made, kept = hash_children(digests, counts)
    at = 0
    for k, n in enumerate(counts):
        own = [d.tobytes().hex() for d in digests[at : at + n]]
        assert made[k].tobytes().hex() == sha(own)
        for slot in range(n):
            other = rng.integers(0, 256, (1, 32), dtype=np.uint8)
            around = np.zeros((1, 16, 32), np.uint8)
            around[0, slot + 1 : n] = digests[at + slot + 1 : at + n]  # nothing left of the slot is needed
            new = resume(kept[at + slot : at + slot + 1], other, around, np.array([slot]), np.array([n]))
            assert new[0].tobytes().hex() == sha([*own[:slot], other[0].tobytes().hex(), *own[slot + 1 :]])
        at += n
    assert kept[0].tobytes() == as_bytes(start(1)).tobytes()


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17, "b": 1}, {"a": 300, "b": 33, None: 2, "é": 1, "": 3}])
def test_equals_brute_force(spark, sizes):
    rng = random.Random(3)
    rows = [(k, s, "de", k, rng.choice(["Ei", "Mehl ÄB", "", None]) and f"Teig {k} Q") for s, n in sizes.items() for k in range(n)]
    check(spark, rows)


def test_many_sources_nulls_and_repeated_rows(spark):
    rows = [(k, f"s{k:03d}", None, None, "T") for k in range(40)]
    rows += [(5, "s001", "fr", 3, "Zwei"), (5, "s001", "fr", 3, "Zwei"), (5, "s001", "fr", 3, "zwei"), (None, None, None, None, None), (None, "s001", "x", 1, "A")]
    rows += [(7, "long", "en", 1, "Lang " * 60000)]
    check(spark, rows)


def test_a_source_with_most_rows(spark):
    check(spark, [(k, "hot" if k % 10 else f"s{k}", "de", 1, f"R{k}") for k in range(3000)])


def test_nothing_found_else_and_no_dossiers(spark):
    df = spark.createDataFrame([(1, "a", "de", 2, "AB"), (2, "a", "de", 2, "CD")], DOSSIERS)
    manifest = build_manifest(df)
    rows = check_dossiers(manifest).collect()
    assert all(r.verified and r.folded_root == manifest.root for r in rows) and len(rows) == 2
    none = check_dossiers(build_manifest(df.limit(0)))
    assert none.count() == 0 and none.schema == check_dossiers(manifest).schema
