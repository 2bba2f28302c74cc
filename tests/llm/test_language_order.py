import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm.language import learn_and_score, score_dossiers, train_language_model
from larder.llm.words import Words
from larder.session import ensure_checkpoint_dir
from tests.llm.test_language import discounts, tokens


def words_alike(bits=40, n=4_000_000):
    """Two words whose hashes share the first ``bits`` bits, and no more than 60."""
    names = np.char.add("w", np.arange(n).astype(str))
    hashes = Words(pa.array([" ".join(names)])).hashes
    order = np.argsort(hashes)
    cut = hashes[order] >> np.uint64(64 - bits)
    at = order[np.flatnonzero(cut[1:] == cut[:-1])[0] + np.array([0, 1])]
    return [str(names[k]) for k in at]


def test_words_with_nearly_the_same_hash_stay_apart(spark):
    known, other = words_alike()
    df = spark.createDataFrame([(1, known), (2, other)], "recipe_id long, text string")
    model = train_language_model(df.filter("recipe_id = 1"))
    assert (model.tokens, model.distinct) == (2, 2)
    rows = {r.recipe_id: r for r in score_dossiers(df, model).collect()}
    assert (rows[1].n_known, rows[2].n_known) == (2, 1)
    assert rows[2].base_score < rows[1].base_score
    both = train_language_model(df)
    assert (both.tokens, both.distinct, both.pair_types) == (4, 3, 4)


class Brute:
    """Modified Kneser-Ney of any order, gram by gram."""

    def __init__(self, texts, order):
        self.order = order
        rows = [["<s>", *tokens(x)] for x in texts]
        at = lambda k: Counter(tuple(r[i : i + k]) for r in rows for i in range(len(r) - k + 1))
        raw = {k: at(k) for k in range(1, order + 1)}
        self.c = {k: dict(raw[k]) for k in raw}
        for k in range(1, order):
            before = Counter(g[1:] for g in raw[k + 1])
            self.c[k] = {g: n if k > 1 and g[0] == "<s>" else before[g] for g, n in raw[k].items() if g != ("<s>",)}
        self.d = {k: discounts(c.values()) for k, c in self.c.items()}
        self.after = {k: defaultdict(list) for k in self.c}
        for k, c in self.c.items():
            for g, n in c.items():
                self.after[k][g[:-1]].append(n)

    def p(self, context, word):
        k = len(context) + 1
        low = self.p(context[1:], word) if context else 1 / (len(self.c[1]) + 1)
        counts = self.after[k][tuple(context)]
        if not counts:
            return low
        n, d, total = self.c[k].get((*context, word), 0), self.d[k], sum(counts)
        return (n - d[min(n, 3)]) / total + sum(d[min(c, 3)] for c in counts) / total * low

    def score(self, text):
        row = ["<s>", *tokens(text)]
        return sum(math.log10(self.p(row[max(0, i - self.order + 1) : i], row[i])) for i in range(1, len(row)))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_any_order_against_brute_force(spark, order):
    rng = random.Random(order)
    vocabulary = [f"Wort{int(rng.paretovariate(0.9))}" for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (205, "wort1"), (None, "wort1 wort2 neu wort1 wort2"), (301, "wort1 wort2 " * 300)]
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    model = train_language_model(df.filter("recipe_id is null or recipe_id % 5 != 1"), order=order)
    brute = Brute([t for i, t in rows if i is None or i % 5 != 1], order)
    for context in (["<s>"], ["<s>", "wort1"][-order + 1 :], ["wort1", "wort2"][-order + 1 :], ["x", "wort1"][-order + 1 :]):
        assert sum(brute.p(context, w) for (w,) in [*brute.c[1], ("unknown",)]) == pytest.approx(1.0)
    got = sorted((str(r.recipe_id), r.score) for r in score_dossiers(df, model, block_bytes=3000).collect())
    expected = sorted((str(i), brute.score(t)) for i, t in rows)
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert [g[1] for g in got] == pytest.approx([e[1] for e in expected], rel=1e-9)


def files(folder):
    return {str(p): p.stat().st_size for p in Path(folder).rglob("*") if p.is_file()}


@pytest.mark.parametrize("order", [2, 3, 4])
def test_learning_and_scoring_in_one_pass_against_brute_force(spark, order):
    rng = random.Random(10 + order)
    vocabulary = [f"Wort{int(rng.paretovariate(0.8))}" for _ in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (205, "wort1"), (None, "wort1 neu wort1"), (301, "nur hier " * 200), (301, "nur hier " * 200)]
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    learnt = [t for i, t in rows if i is not None and i % 5 != 1]
    model, scores = learn_and_score(df, F.col("recipe_id") % 5 != 1, order, block_bytes=3000)
    count, brute = Counter(t for x in learnt for t in tokens(x)), Brute(learnt, order)
    assert (model.tokens, model.distinct) == (sum(count.values()), len(count))
    base = lambda text: sum(math.log10((count[t] + 0.5) / (model.tokens + 0.5 * (len(count) + 1))) for t in tokens(text))
    expected = sorted((str(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), base(t), brute.score(t)) for i, t in rows)
    got = sorted((str(r.recipe_id), *r[1:]) for r in scores.collect())
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    for k in (3, 4):
        assert [g[k] for g in got] == pytest.approx([e[k] for e in expected], rel=1e-9)
    with pytest.raises(ValueError, match="not kept"):
        score_dossiers(df, model)


def test_disk_of_learning_and_scoring_stays_near_the_texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"wort{int(rng.paretovariate(0.5)) % 50000}" for _ in range(400))) for i in range(1000)]
    df = spark.createDataFrame(rows, "recipe_id long, text string").repartition(4)
    text_bytes = sum(len(t) for _, t in rows)
    shuffles = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    checkpoints = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = files(checkpoints) | files(shuffles)
    learn_and_score(df, F.col("recipe_id") % 5 != 1)
    after = files(checkpoints) | files(shuffles)
    assert sum(size for name, size in after.items() if name not in before) < 2 * text_bytes
