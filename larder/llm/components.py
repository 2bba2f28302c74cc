"""Connected components of a graph given as a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (``a``, ``b``): the same root for all nodes that links connect.

    Each pass lets every node follow its smallest neighbour, if smaller, and merges nodes with the one
    they follow, until no link is left. Tables of the passes are written to ``folder``, so no plan
    grows and a lost executor repeats one pass at most. A node with very many links only takes part with partial minima and in
    joins of two scans, whose large partitions adaptive execution splits.
    """
    spark = links.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    links = stored(links.filter("a != b").select("a", "b").distinct(), "links0")
    roots, k = None, 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        follow = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("next"))
        follow = stored(follow, f"follow{k}")
        left = links.join(follow.withColumnRenamed("node", "a"), "a").select(F.col("next").alias("a"), "b")
        links = left.join(follow.withColumnRenamed("node", "b"), "b").select("a", F.col("next").alias("b"))
        links = stored(links.filter("a != b").distinct(), f"links{k + 1}")
        if roots is None:
            roots = follow.withColumnRenamed("next", "root")
        else:
            onward = follow.withColumnRenamed("node", "root")
            roots = roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = stored(roots, f"roots{k}")
        k += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
