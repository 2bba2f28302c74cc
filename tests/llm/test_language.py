import math
import random
from collections import Counter, defaultdict

import pytest

from larder.llm.language import score_dossiers, train_language_model


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*lower.split(), "</s>"]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    if not (n[0] and n[1]):
        return [0, 0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5
        out.append(min(max(d, 0.05), k - 0.05))
    return out


class Brute:
    def __init__(self, texts):
        self.c = Counter(t for x in texts for t in tokens(x))
        self.pairs = Counter(p for x in texts for p in zip(["<s>", *tokens(x)], tokens(x), strict=False))
        self.after = defaultdict(list)
        for (v, _), n in self.pairs.items():
            self.after[v].append(n)
        self.ends = Counter(w for _, w in self.pairs)
        self.d1, self.d2 = discounts(self.ends.values()), discounts(self.pairs.values())
        self.n, self.v = sum(self.c.values()), len(self.c)

    def p(self, v, w):
        types = len(self.pairs)
        left = sum(self.d1[min(n, 3)] for n in self.ends.values()) / types
        n = self.ends[w]
        low = (n - self.d1[min(n, 3)]) / types + left / (self.v + 1)
        if not self.after[v]:
            return low
        n, total = self.pairs[(v, w)], sum(self.after[v])
        return (n - self.d2[min(n, 3)]) / total + sum(self.d2[min(k, 3)] for k in self.after[v]) / total * low

    def row(self, i, text):
        ts = tokens(text)
        base = sum(math.log10((self.c[t] + 0.5) / (self.n + 0.5 * (self.v + 1))) for t in ts)
        score = sum(math.log10(self.p(v, w)) for v, w in zip(["<s>", *ts], ts, strict=False))
        return i, len(ts), sum(self.c[t] > 0 for t in ts), base, score


def test_scores_against_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"Wort{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["ÖL", "日本", "salz,"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 80)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "wort1 neu"), (7, "Wort1"), (300, "wort1 wort2 " * 1500)]
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    train = [t for i, t in rows if i is None or i % 5 != 1]
    model = train_language_model(df.filter("recipe_id is null or recipe_id % 5 != 1"), order=2)
    brute = Brute(train)
    assert (model.tokens, model.distinct, model.pair_types) == (brute.n, brute.v, len(brute.pairs))
    got = sorted((tuple(r) for r in score_dossiers(df, model, block_bytes=3000).collect()), key=repr)
    expected = sorted((brute.row(i, t) for i, t in rows), key=repr)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    for g, e in zip(got, expected, strict=True):
        assert g[3:] == pytest.approx(e[3:], rel=1e-9)
    held_out = [g for g in got if g[0] is not None and g[0] % 5 == 1]
    assert sum(10 ** brute.row(0, "x")[4] > 0 for _ in held_out)


def test_probabilities_add_up_to_one():
    brute = Brute(["a b a c", "b a", "c c c a b"])
    for v in ("<s>", "a", "c", "zz"):
        assert sum(brute.p(v, w) for w in [*brute.c, "unknown"]) == pytest.approx(1.0)


def test_empty_model_and_corpus(spark):
    none = spark.createDataFrame([], "recipe_id long, text string, slice int")
    model = train_language_model(none)
    assert score_dossiers(none, model).count() == 0
    some = spark.createDataFrame([(1, "a b")], "recipe_id long, text string")
    assert [tuple(r) for r in score_dossiers(some, model).collect()] == [(1, 3, 0, 0.0, 0.0)]
