import random
import re
from collections import Counter

import zstandard

from larder.llm.textrules import BANDS, CHUNK_BYTES, judge_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    again = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    data = text.encode()
    ratio = lambda part: len(zstandard.ZstdCompressor(level=3).compress(part)) / len(part)
    # full chunks that begin every quarter of a chunk, and the one that ends with the text
    begins = [k for k in range(len(data) - CHUNK_BYTES + 1) if k % (CHUNK_BYTES // 4) == 0 or k == len(data) - CHUNK_BYTES]
    chunks = [ratio(data[k : k + CHUNK_BYTES]) for k in begins]
    band = [b for b in BANDS if len(data) >= b.min_bytes][-1]
    fine = not data or band.whole_low <= ratio(data) <= band.whole_high
    fine = fine and all(band.chunk_low <= c <= band.chunk_high for c in chunks)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(again), failed, not failed and fine


def run(spark, rows):
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    got = judge_texts(df).collect()
    keep = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return [(r.recipe_id, *(r[k] for k in keep)) for r in got], got


def test_counts_and_bands_against_brute_force(spark):
    rng = random.Random(2)
    prose = [f"wort{rng.randint(0, 900)}ß" for _ in range(2000)]
    noise = "".join(rng.choices([chr(c) for c in range(33, 127)], k=9000))
    texts = [
        None, "", "\n \n", "a", "a b c a b c", "x\nx\n x\n\n\n", " ".join(prose), " ".join(prose[:60]), "# * $% &|<> " * 30,
        "日本 語 " * 60, " ".join(prose[:80]) + "\n" + "\n".join(["gleich"] * 40), " ".join(re.findall("." * 12, noise)), "y" * 20000,
        " ".join(prose) + " und" * 6000, "\n".join(" ".join(rng.choices(prose, k=8)) for _ in range(40)),
    ]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a b"), (3, "a"), (3, "a")]
    # noise that no chunk of a disjoint cut would be filled with, in prose; and texts of more than a megabyte
    code = noise[:5000]
    rows += [(20, " ".join(prose[:400]) + code[:4096] + " ".join(prose[:900])), (21, " ".join(prose) + " " + code[:3500]), (22, " ".join(prose * 60)), (23, "y" * 1500000)]
    got, full = run(spark, rows)
    assert sorted(got, key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    kept = {r.recipe_id: r.kept for r in full}
    assert kept[6] and kept[7] and not kept[13]
    assert not kept[11]  # incompressible, though no word repeats
    assert not kept[20] and not kept[23]
    assert run(spark, [])[0] == []


def test_columns_of_the_result_in_the_input_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b", True, 5)], "recipe_id long, text string, kept boolean, n_words int")
    assert [(r.recipe_id, r.n_words, r.kept) for r in judge_texts(df).collect()] == [(1, 2, False)]
