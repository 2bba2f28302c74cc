import base64
import random

import pytest

from larder.llm.textrules import judge_texts


def prose(rng, size):
    words = ["the", "soup", "salted", "kettle", "pepper", "slowly", "garden", "winter", "of", "and", "onions", "stirring", "bread", "under"]
    words += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(600)]
    out = ""
    while len(out) < size:
        out += rng.choice(words) + rng.choice([" ", " ", " ", ", ", ".\n"])
    return out[:size]


def base64_lines(rng, size):
    return base64.encodebytes(rng.randbytes(size))[:size].decode()


def printable_words(rng, size):
    return "".join(" " if k % 12 == 11 else chr(rng.randint(33, 126)) for k in range(size))


@pytest.mark.parametrize("noise", [base64_lines, printable_words])
def test_noise_is_rejected_at_the_end_and_inside(spark, noise):
    rng = random.Random(4)
    texts = {1: prose(rng, 700), 2: prose(rng, 4200), 3: prose(rng, 9000), 4: prose(rng, 40000)}
    good = set(texts)
    for k, before in enumerate([4096, 6000, 7000, 9500, 20000]):
        texts[10 + k] = prose(rng, before) + noise(rng, 4000)
        texts[20 + k] = prose(rng, before) + noise(rng, 4000) + prose(rng, 7000)
        texts[30 + k] = noise(rng, 4000) + prose(rng, before)
    for k, size in enumerate([4096, 5000, 8192, 12000, 16383, 30000]):
        texts[40 + k] = noise(rng, size)
    df = spark.createDataFrame(list(texts.items()), "recipe_id long, text string")
    rows = {r.recipe_id: r for r in judge_texts(df).collect()}
    assert {i for i, r in rows.items() if r.kept} == good
    assert not any(r.base_failed for r in rows.values())
