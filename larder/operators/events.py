"""Statistics over tool events ``(tool, started_at, duration_ms, success, error)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent_events(events: DataFrame, n: int = 20) -> DataFrame:
    """Latest ``n`` events, newest first."""
    return events.orderBy(F.col("started_at").desc(), *[F.col(c) for c in events.columns if c != "started_at"]).limit(n)


def event_stats(events: DataFrame) -> DataFrame:
    """Totals, successes, errors, mean and longest duration in one row."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("success").alias("success"),
        F.count_if(~F.col("success")).alias("error"),
        F.round(F.avg("duration_ms"), 1).alias("avg_ms"),
        F.round(F.max("duration_ms"), 1).alias("max_ms"),
    )


def tool_stats(events: DataFrame) -> DataFrame:
    """Calls, errors and mean duration per tool, by name."""
    return (
        events.groupBy("tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if(~F.col("success")).alias("errors"),
            F.round(F.avg("duration_ms"), 1).alias("avg_ms"),
        )
        .orderBy("tool")
    )
