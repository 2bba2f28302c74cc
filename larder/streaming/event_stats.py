"""Rolling statistics over a stream of tool events.

Two ways: :func:`windowed_tool_stats` keeps windows in the state of the stream up to a watermark, and drops what comes later.
:func:`start_window_parts` keeps no state: each batch writes what it adds to its windows, however late its events are, and the parts of a window are
added up when they are read. Parts of many batches are merged level by level, as in :mod:`larder.streaming.key_index`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from larder.streaming.key_index import FAN, live_folders


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """Stream over Parquet files of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def windowed_tool_stats(
    events: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str | None = "10 minutes"
) -> DataFrame:
    """Calls, errors and durations per tool and time window; late events beyond the watermark are dropped.

    Without a watermark (None) no event is late, whatever the order of the files, and no window leaves the state.
    Works on batch frames as well (the watermark then has no effect).
    """
    window = F.window("started_at", width, slide) if slide else F.window("started_at", width)
    return (
        (events.withWatermark("started_at", watermark) if watermark else events)
        .groupBy(window.alias("w"), "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(~F.col("success")).alias("errors"),
            F.avg("duration_ms").alias("avg_ms"),
            F.max("duration_ms").alias("max_ms"),
        )
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "calls", "errors",
            "avg_ms", "max_ms",
        )
    )


def start_tool_stats(stats: DataFrame, folder: str, progress: str) -> StreamingQuery:
    """Write what each batch changes to ``folder``, one sub-folder per batch; a batch that runs again replaces its own.

    Windows behind the watermark, if there is one, leave the state; no row passes the driver.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    sink = stats.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", progress)
    return sink.trigger(availableNow=True).start()


def read_tool_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of each window and tool."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in ("window_start", "tool", "batch")]
    last = rows.groupBy("window_start", "tool").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select("window_start", "tool", *[F.col(f"v.{c}").alias(c) for c in values])


_PARTS = ["calls", "errors", "timed", "total_ms", "max_ms"]


def window_parts(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """What some events add to each window (``window_start``, ``window_end``) and tool; of several such rows the sums, and the largest ``max_ms``, hold."""
    window = F.window("started_at", width, slide) if slide else F.window("started_at", width)
    parts = events.groupBy(window.alias("w"), "tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.count("duration_ms").alias("timed"),
        F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
    )
    return parts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", *_PARTS)


def _merged(parts: DataFrame) -> DataFrame:
    added = [F.sum(c).alias(c) for c in _PARTS[:-1]]
    return parts.groupBy("window_start", "window_end", "tool").agg(*added, F.max("max_ms").alias("max_ms"))


def start_window_parts(
    events: DataFrame, folder: str, progress: str, width: str = "1 hour", slide: str | None = None, fan: int = FAN
) -> StreamingQuery:
    """Write the parts of each batch to ``folder``; a batch that runs again replaces its own and the merged parts that hold it.

    Events without a time belong to no window. No event is late and nothing stays in memory between batches: after n batches the parts of
    at most ``(fan - 1) * (1 + log(n))`` folders count.
    """
    base = folder.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        window_parts(batch, width, slide).write.mode("overwrite").parquet(f"{base}/level=0/n={batch_id}")
        level, done = 1, batch_id + 1
        while done % fan == 0:
            done //= fan
            below = _scan(batch.sparkSession, base).filter((F.col("level") == level - 1) & F.col("n").between((done - 1) * fan, done * fan - 1))
            _merged(below).write.mode("overwrite").parquet(f"{base}/level={level}/n={done - 1}")
            level += 1

    sink = events.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    return sink.trigger(availableNow=True).start()


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    schema = "window_start timestamp, window_end timestamp, tool string, calls long, errors long, timed long, total_ms double, max_ms double, level int, n int"
    return spark.read.schema(schema).parquet(folder)


def live_parts(spark: SparkSession, folder: str, fan: int = FAN) -> DataFrame:
    """The parts that count, with ``level`` and ``n`` of their folder."""
    parts = _scan(spark, folder)
    done = int(parts.agg(F.max((F.col("n") + 1) * F.pow(F.lit(fan), F.col("level")))).first()[0] or 0)
    counted = F.lit(False)
    for level, n in live_folders(done, fan):
        counted = counted | ((F.col("level") == level) & (F.col("n") == n))
    return parts.filter(counted)


def read_window_stats(spark: SparkSession, folder: str, fan: int = FAN) -> DataFrame:
    """Calls, errors and durations per window and tool, as :func:`windowed_tool_stats` gives them for all events at once."""
    rows = _merged(live_parts(spark, folder, fan))
    return rows.select("window_start", "window_end", "tool", "calls", "errors", (F.col("total_ms") / F.nullif("timed", F.lit(0))).alias("avg_ms"), "total_ms", "max_ms")
