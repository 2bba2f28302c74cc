import random
import zlib

import numpy as np
import pytest

from larder.llm.packing import balance, pack_dossiers
from larder.llm.tokens import Encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "", " ", "\n\n a", "It's  we'll 'tis ''s I'd've'x don't' 't", "a \t b\r\n  c   ", "Crème brûlée, 12½ g; №5 – „Rübe“…",
    "日本語 text", "x y​z\x00", "'S 'LL 'lla '", "!'s !!'re  're", " 's", "1st 2nd3 ٣ Привет мир ελιά", "emoji 🍲 soup", "a'", "l'",
    "d'd", "end ", "end  ", "\t\t", "'ve", "<|endoftext|> x",
]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(reference):
    rng = random.Random(3)
    signs = " \t\n'aeSt12,.é½ЖλrevlmdLs"
    texts = TEXTS + ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    coder = Encoder(PATH)
    for _ in range(2):
        assert [i.tolist() for i in coder.encode(texts)] == [reference(t) for t in texts]


def test_long_texts_are_cut_between_parts(reference, monkeypatch):
    monkeypatch.setattr("larder.llm.tokens.PIECE_CHARS", 50)
    text = "Zwiebel  hacken,\n\n und \t dünsten. It's done! " * 40
    assert Encoder(PATH).encode([text, "a"])[0].tolist() == reference(text)


def test_pieces_cover_every_token_once(spark, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (51, "Lauch " * 3000), (51, "Lauch " * 3000), (None, "ohne Nummer")]
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    got = pack_dossiers(df, PATH, capacity=64, group_pieces=20).collect()
    by_text = {}
    for i, t in rows:
        ids = [*reference(t or ""), 1]
        for a in range(0, len(ids), 64):
            p = ids[a : a + 64]
            key = (i, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids))
            by_text[key] = by_text.get(key, 0) + 1
    for r in got:
        by_text[(r.recipe_id, r.start, r.length, r.ids_crc32, r.doc_tokens)] -= 1
    assert set(by_text.values()) == {0}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack_dossiers(df.limit(0), PATH).count() == 0


def test_equal_rows_and_a_very_long_text_are_dealt_to_all_groups(spark, reference):
    rows = [(7, "Zwiebeln in Butter dünsten", 0, 0)] * 1500 + [(k, f"Schritt {k}", 1, 1) for k in range(1000, 1500)] + [(9000, "Lauch putzen. " * 20000, 2, 2)]
    # names that the operator's own columns have
    df = spark.createDataFrame(rows, "recipe_id long, text string, pack_group int, sequence_id int").repartition(3)
    got = pack_dossiers(df, PATH, capacity=64, group_pieces=200)
    assert got.columns == ["recipe_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
    got = got.collect()
    sizes = np.unique([r.sequence_id >> 32 for r in got], return_counts=True)[1]
    assert len(sizes) == -(-len(got) // 200) and sizes.max() < 300
    assert sum(r.recipe_id == 7 for r in got) == 1500
    ids = len(reference("Lauch putzen. " * 20000)) + 1
    assert sum(r.length for r in got if r.recipe_id == 9000) == ids


def test_costs_are_balanced_and_little_is_padded():
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(1, 2049, 3000))[::-1]
    sequence, offset, cost = balance(lengths, 2048)
    used = np.bincount(sequence, weights=lengths)
    assert used.max() <= 2048 and lengths.sum() / (len(used) * 2048) > 0.97
    spent = np.bincount(sequence, weights=cost)
    in_turn = np.add.reduceat(cost, np.arange(0, 3000, 2))  # neighbours together
    assert spent.std() < in_turn.std()
