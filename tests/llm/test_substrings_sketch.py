import numpy as np

from larder.llm.blocks import gather, pack
from larder.llm.substrings import _merge


def test_the_sketch_adds_up_the_counts_of_all_blocks():
    column = lambda *x: np.array(x, dtype=np.uint64)
    # cell 3: once in each block; 5: twice in one block; 7 and 9: once in all
    payloads = [pack(column(3, 5, 7), column(1, 2, 1)), pack(column(3, 9), column(1, 1))]
    found = {block: gather([p], 2)[0][0][1:].tolist() for block, p in _merge(0, [4, 6], payloads)}
    assert found == {4: [3, 5], 6: [3]}
