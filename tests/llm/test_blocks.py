import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import blocks as B
from larder.llm.substrings import drop_repeated_passages


@pytest.mark.parametrize("bits", [0, 1, 4, 30, 64])
def test_cut_gives_each_slice_with_values_once(bits):
    rng = np.random.default_rng(bits)
    values = np.sort(np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), np.array([0, 0, (1 << 64) - 1], dtype=np.uint64)]))
    got = list(B.cut(values, bits))
    top = [int(v) >> (64 - bits) for v in values]
    assert [(s, b - a) for s, a, b in got] == [(s, top.count(s)) for s in sorted(set(top))]
    assert [a for _, a, _ in got] == [0, *[b for *_, b in got[:-1]]] and got[-1][2] == len(values)
    assert list(B.cut(values[:0], bits)) == []


def test_narrow_values_are_cut_by_their_own_top_bits():
    values = np.arange(16, dtype=np.uint64)
    assert list(B.cut(values, 2, 4)) == [(0, 0, 4), (1, 4, 8), (2, 8, 12), (3, 12, 16)]


def test_messages_do_not_become_smaller_with_the_corpus():
    for text_bytes in (10**9, 10**10, 10**11, 10**12, 10**13, 10**14):
        values = text_bytes // B.WORD_BYTES
        blocks, slices = -(-text_bytes // B.block_size(text_bytes)), 1 << B.slice_bits(values)
        assert values / blocks / slices > B.MESSAGE_VALUES / 2.1
        assert values / slices <= 10**8 and B.block_size(text_bytes) <= 600e6
    assert (B.block_size(5 * 10**9), B.slice_bits(10**8)) == (B.BLOCK_BYTES, 7)


def test_many_small_blocks_send_each_slice_one_message_at_most(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j) % 211}" for j in range(40))) for k in range(300)]
    df = spark.createDataFrame(rows, "recipe_id long, text string")
    blocks = B.Blocks(df, 2000)
    assert blocks.count > 20

    def ask(block, table):
        hashes = np.sort(B.ids_of(table).astype(np.uint64) << np.uint64(54))
        return B.messages(block, ((s, B.pack(hashes[a:b])) for s, a, b in B.cut(hashes, 4)))

    sent = blocks.send(ask).groupBy("slice", "block").count().agg(F.max("count").alias("most"), F.count("*").alias("n")).first()
    assert sent["most"] == 1 and sent["n"] <= blocks.count * 16
    small, large = (sorted(drop_repeated_passages(df, 5, block_bytes=b).collect()) for b in (2000, None))
    assert small == large
