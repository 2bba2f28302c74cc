"""Streaming ingest: raw records arrive as files, each becomes at most one stored recipe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larder.operators.ingest import accepted, decide, with_hash
from larder.schemas import RAW_RECIPE
from larder.streaming.key_index import KeyIndex

RECORD_STREAM = T.StructType(
    [
        *RAW_RECIPE.fields,
        T.StructField("source_id", T.IntegerType()),
        T.StructField("position", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def record_stream(spark: SparkSession, folder: str, max_files_per_batch: int = 1_000) -> DataFrame:
    """Stream over Parquet files of raw records."""
    return (
        spark.readStream.schema(RECORD_STREAM).option("maxFilesPerTrigger", max_files_per_batch).parquet(folder)
    )


def start_ingest(
    records: DataFrame, target: str, checkpoint: str, languages: Sequence[str] | None = None
) -> StreamingQuery:
    """Process everything available now; progress and batch numbers live in the checkpoint folder.

    A batch is deduplicated against the stored URLs and hashes, which replaces an ever-growing deduplication state. These keys
    are indexed by hash next to the target (``<target>_keys``), so a batch reads only the buckets that its own keys fall into
    (:mod:`larder.streaming.key_index`). Every batch has its own sub-folder, which is overwritten when the batch runs again after a
    failure; a batch never looks at its own earlier attempt.
    """
    folder = target.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        urls, hashes = (KeyIndex(spark, f"{folder}_keys/{kind}") for kind in ("source_url", "content_hash"))
        own = with_hash(batch).select("source_url", "content_hash")
        stored = [
            index.near(own.select(F.col(column).alias("key")).filter("key is not null"), batch_id).withColumnRenamed("key", column)
            for column, index in (("source_url", urls), ("content_hash", hashes))
        ]
        known = stored[0].unionByName(stored[1], allowMissingColumns=True)
        path = f"{folder}/batch={batch_id}"
        accepted(batch, decide(batch, known, languages)).write.mode("overwrite").parquet(path)
        # what was written is indexed afterwards: a batch that breaks off in between runs again as a whole
        added = spark.read.schema("source_url string, content_hash string").parquet(path)
        urls.add(added.select(F.col("source_url").alias("key")), batch_id)
        hashes.add(added.select(F.col("content_hash").alias("key")), batch_id)

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
