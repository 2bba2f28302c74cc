"""Which keys are stored already: an index in buckets by hash, of which a batch reads only those that its own keys fall into.

Each batch adds one folder with its keys, dealt to buckets. Every ``FAN`` folders of a level are merged to one of the next level, so after n
batches at most ``(FAN - 1) * (1 + log(n))`` folders count, with one file per bucket each, and a key is written again once per level. Which folders count
follows from the number of the batch alone: a batch that runs again reads what it read before and replaces what it wrote.
Merged folders leave the smaller ones behind; those can be removed at any time between two runs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the index (fixed for the life of an index), and folders of a level that are merged.
BUCKETS, FAN = 64, 8
_SCHEMA = "key string, level int, n int, bucket int"
_KEYS = "key string, bucket int"


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def live_folders(batch_id: int, fan: int = FAN) -> list[tuple[int, int]]:
    """``(level, number)`` of the folders with the keys of all batches before ``batch_id``: the digits of that number."""
    out, level, rest = [], 0, batch_id
    while rest:
        rest, digit = divmod(rest, fan)
        out += [(level, rest * fan + k) for k in range(digit)]
        level += 1
    return out


class KeyIndex:
    """The keys of one kind under ``folder``; a null key is never stored."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, fan: int = FAN):
        self.spark, self.folder, self.buckets, self.fan = spark, folder.rstrip("/"), buckets, fan

    def _path(self, level: int, number: int) -> str:
        return f"{self.folder}/level={level}/n={number}"

    def _read(self, folders: Iterable[tuple[int, int]]) -> DataFrame:
        """Folders without any key may be missing."""
        paths = [self._path(*f) for f in folders]
        found = self._scan(paths) or self._scan([p for p in paths if self._scan([p])])
        return self.spark.createDataFrame([], _KEYS) if found is None else found.select("key", "bucket")

    def _scan(self, paths: list[str]) -> DataFrame | None:
        try:
            return self.spark.read.schema(_SCHEMA).option("basePath", self.folder).parquet(*paths) if paths else None
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    def _write(self, keys: DataFrame, level: int, number: int) -> None:
        # all rows of a bucket in one task, so a folder has one file per bucket
        dealt = keys.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "key")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(self._path(level, number))

    def add(self, keys: DataFrame, batch_id: int) -> None:
        """Store the keys (column ``key``) of a batch in place of those of an earlier attempt, and merge the levels that it fills."""
        own = keys.select("key").filter("key is not null").distinct().withColumn("bucket", bucket_of("key", self.buckets))
        self._write(own, 0, batch_id)
        level, done = 1, batch_id + 1
        while done % self.fan == 0:
            done //= self.fan
            below = [(level - 1, (done - 1) * self.fan + k) for k in range(self.fan)]
            self._write(self._read(below).distinct(), level, done - 1)
            level += 1

    def near(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """Stored keys (column ``key``) of batches before ``batch_id`` in the buckets that ``keys`` fall into."""
        mine = keys.select(bucket_of("key", self.buckets).alias("bucket")).distinct().collect()
        stored = self._read(live_folders(batch_id, self.fan))
        return stored.filter(F.col("bucket").isin([row.bucket for row in mine])).select("key")
