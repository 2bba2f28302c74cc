"""The log of running ingests: rows as they were at the start, in between and at the end.

States are appended as files under ``_run_log`` of the data folder that a run starts from, so a run that breaks off leaves its last
state behind; the finished rows are those of ``etl_runs``. A state is one row per source: the log grows with runs, not with records.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.durations import utc_literal
from larder.operators.ingest import close_interrupted
from larder.schemas import schema_for
from larder.sources.tables import conform

COUNTERS = ("discovered", "fetched", "skipped", "errors", "validation_skipped")
# Dispositions that a counter of a run adds up.
COUNTED = {
    "discovered": (),
    "fetched": ("new",),
    "skipped": ("known", "language", "duplicate"),
    "errors": ("error",),
    "validation_skipped": ("invalid",),
}


def log_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/_run_log"


def _states(spark: SparkSession, folder: str) -> DataFrame:
    schema = T.StructType([*schema_for("etl_runs").fields, T.StructField("state_no", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(log_path(folder))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def append_states(runs: DataFrame, folder: str, state_no: int) -> None:
    """Add one state of some runs (``etl_runs`` columns)."""
    conform(runs, "etl_runs").withColumn("state_no", F.lit(state_no)).coalesce(1).write.mode("append").parquet(log_path(folder))


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    """The latest state of every run, ``etl_runs`` columns: what a look at the running ingests shows."""
    columns = schema_for("etl_runs").names
    latest = _states(spark, folder).groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), "state_no").alias("r"))
    return latest.select(*[F.col(f"r.`{c}`").alias(c) for c in columns])


def starting_rows(
    sources: DataFrame, started_at: datetime, first_id: int, *, batch_size: int | None = None, limit: int | None = None
) -> DataFrame:
    """A ``running`` row without counts per source of a run, ids by source id from ``first_id`` on. Sources are a table of some dozens of rows."""
    ids = F.row_number().over(Window.orderBy("id")) + F.lit(first_id - 1)
    return sources.select(
        ids.cast("long").alias("id"), F.col("id").alias("source_id"), F.col("key").alias("source"), utc_literal(started_at).alias("started_at"),
        *[F.lit(0).alias(c) for c in (*COUNTERS, "soft_deleted")],
        F.lit(batch_size).cast("smallint").alias("batch_size"), F.lit(limit).cast("int").alias("limit"), F.lit("running").alias("status"),
    )


def counting(source_ids: list[int]) -> dict[str, Column]:
    """Metrics that are counted while decisions are written: one per source and counter."""
    out = {}
    for source in source_ids:
        mine = F.col("source_id") == source
        for counter, kinds in COUNTED.items():
            out[f"{counter}_{source}"] = F.count_if(mine & F.col("disposition").isin(*kinds) if kinds else mine)
    return out


def with_progress(running: DataFrame, metrics: Mapping[str, int], source_ids: list[int]) -> DataFrame:
    """Running rows with the counts that the metrics gave."""
    seen = [(s, *[int(metrics[f"{c}_{s}"]) for c in COUNTERS]) for s in source_ids]
    counts = running.sparkSession.createDataFrame(seen, "source_id int, " + ", ".join(f"{c} int" for c in COUNTERS))
    return running.drop(*COUNTERS).join(F.broadcast(counts), "source_id")


def crashed(states: DataFrame, sources: DataFrame, now: datetime) -> DataFrame:
    """Rows of ``states`` that still run for one of ``sources``, closed as crashed."""
    mine = states.filter("status = 'running'").join(F.broadcast(sources.select(F.col("key").alias("source"))), "source", "left_semi")
    mine = mine.select(*states.columns)
    # every row here is one of a source that starts anew
    return close_interrupted(mine.withColumn("_key", F.col("source")).withColumn("source", F.lit("*")), "*", now).withColumn("source", F.col("_key")).drop("_key")
