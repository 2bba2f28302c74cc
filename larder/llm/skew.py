"""Joining rows with facts about their group when one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of all rows is hot. There cannot be more such groups than this number.
HOT_SHARE = 1000


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per key and the number of its rows as ``group_rows``.

    Hot groups are broadcast: at most HOT_SHARE of them exist, whatever the input. The rows of all others are
    shuffled by key, with less than a thousandth of them on any one key.
    """
    is_hot = F.col("group_rows") * HOT_SHARE > total
    hot, others = groups.filter(is_hot).drop("group_rows"), groups.filter(~is_hot).drop("group_rows")
    beside = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(beside.join(others, keys))
