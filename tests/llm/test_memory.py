"""Blocks of operators with many arrays per word are smaller, and workers hand memory back."""

import numpy as np
import pyarrow as pa

from larder.llm.blocks import BLOCK_BYTES, SMALL_BLOCK_BYTES, block_size, freed


def test_small_blocks_follow_the_same_rule_beyond_their_least_size():
    assert block_size(1 << 20, SMALL_BLOCK_BYTES) == SMALL_BLOCK_BYTES < BLOCK_BYTES == block_size(1 << 20)
    assert block_size(10**14, SMALL_BLOCK_BYTES) == block_size(10**14) > 500 << 20


def _anonymous() -> int:
    return next(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Anonymous:"))


def test_freed_memory_goes_back_and_the_result_stays():
    held = [np.ones(1000) for _ in range(20_000)]
    kept, before = np.ones(10), _anonymous()
    held.clear()
    table = pa.table({"a": [1]})
    assert freed(table) is table and kept.sum() == 10 and before - _anonymous() > 100_000
