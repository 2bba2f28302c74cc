"""Versioned runs: read one data folder, write the next one.

Plain Parquet has no in-place update, so a run writes a new folder and the caller switches over when it is complete. The new folder
holds what is new; everything else it refers to, by a list of parts (:func:`larder.sources.tables.read_parts`). Recipes lie in parts by source: where
recipes vanished, the parts of their source are written again, those of other sources are not touched. Folders that are referred to must be kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from larder.operators.changes import max_id
from larder.operators.ingest import IngestRows, error_rows, ingest, run_rows, soft_delete, vanished
from larder.schemas import SCHEMAS
from larder.sources.runlog import append_states, counting, crashed, run_states, starting_rows, with_progress
from larder.sources.tables import Part, conform, read_table, table_exists, table_parts, write_fingerprint, write_parts

# Order of the states of a run in its log.
_RUNNING, _PROGRESS, _FINISHED, _CRASHED = range(4)
#: Sources up to which counts are watched while records are decided on; beyond it the finished rows have them alone.
MAX_WATCHED = 200
_NO_SOURCE = "__HIVE_DEFAULT_PARTITION__"


def run_ingest(
    spark: SparkSession,
    records: DataFrame,
    folder: str,
    next_folder: str,
    catalogue: DataFrame,
    sources: DataFrame,
    started_at: datetime,
    finished_at: datetime,
    *,
    languages: Sequence[str] | None = None,
    limit_per_source: int | None = None,
    failures: DataFrame | None = None,
    batch_size: int | None = None,
) -> IngestRows:
    """Load a batch into a new folder: new rows, soft deletes, the run log, and references to what stays as it was.

    Every one of ``sources`` gets a row in ``etl_runs``; ``failures(source_id, error)`` names those whose discovery failed. While it
    runs, ``_run_log`` of ``folder`` shows a running row per source, with counts as soon as the records are decided on. A run found there
    that never ended is closed as crashed. What became of each record is kept under ``_decided`` of the new folder, with all error texts.
    """
    base = next_folder.rstrip("/")
    old = {t: read_table(spark, folder, t) if table_exists(spark, folder, t) else spark.createDataFrame([], s)
           for t, s in SCHEMAS.items()}
    states = run_states(spark, folder)
    stale = crashed(states, sources, started_at).checkpoint()
    if not stale.isEmpty():
        append_states(stale, folder, _CRASHED)
    first_id = max(max_id(old["etl_runs"]), max_id(states)) + 1
    running = starting_rows(sources, started_at, first_id, batch_size=batch_size, limit=limit_per_source)
    append_states(running.drop("source_id"), folder, _RUNNING)
    source_ids = [row.id for row in sources.select("id").distinct().limit(MAX_WATCHED + 1).collect()]
    watched = len(source_ids) <= MAX_WATCHED

    def keep(decided: DataFrame) -> DataFrame:
        progress = Observation()
        if watched:
            decided = decided.observe(progress, *[c.alias(name) for name, c in counting(source_ids).items()])
        decided.write.mode("overwrite").parquet(f"{base}/_decided")
        if watched:
            append_states(with_progress(running, progress.get, source_ids).drop("source_id"), folder, _PROGRESS)
        return spark.read.schema(decided.schema).parquet(f"{base}/_decided")

    rows = ingest(
        records, old["recipes"], old["tags"], catalogue, started_at,
        languages=languages, limit_per_source=limit_per_source, keep_decided=keep,
    )
    discovered = records.select("source_id", "source_url")
    deleted = vanished(old["recipes"], discovered).checkpoint()
    touched = {row.source_id for row in deleted.select("source_id").collect()}
    parts = [part for table in SCHEMAS for part in table_parts(spark, folder, table)]

    def add(df: DataFrame, table: str, name: str, *by: str) -> list[Part]:
        """Write new files of a table and name their parts; recipes by source."""
        path = f"{base}/{name}"
        writer = conform(df, table)
        if not by:
            writer.write.parquet(path)
            return [Part(table, path)]
        writer.withColumn("_source", F.col("source_id")).write.partitionBy("_source").parquet(path)
        held = spark.read.parquet(path).select("_source").distinct().collect() if not writer.isEmpty() else []
        return [Part(table, f"{path}/_source={row['_source'] if row['_source'] is not None else _NO_SOURCE}", row["_source"]) for row in held]

    if touched:
        # a part that is not of one source holds rows of any
        again = [p for p in parts if p.table == "recipes" and (p.source_id is None or p.source_id in touched)]
        before = spark.read.schema(SCHEMAS["recipes"]).parquet(*[p.path for p in again])
        parts = [p for p in parts if p not in again] + add(soft_delete(before, discovered), "recipes", "recipes.rewritten", "source_id")
    parts += add(rows.recipes, "recipes", "recipes.added", "source_id")
    runs = run_rows(
        sources, rows.decided, started_at, finished_at,
        deleted=deleted, failures=failures, batch_size=batch_size, limit=limit_per_source,
    ).join(F.broadcast(running.select("source_id", "id")), "source_id").drop("source_id").checkpoint()
    new = {
        "recipe_steps": rows.recipe_steps,
        "recipe_images": rows.recipe_images,
        "recipe_ingredients": rows.recipe_ingredients,
        "tags": rows.tags,
        "recipe_tags": rows.recipe_tags,
        "etl_runs": runs.unionByName(stale),
    }
    for table, df in new.items():
        parts += add(df, table, f"{table}.added")
    for table, seed in (("sources", sources), ("ingredients", catalogue)):
        if old[table].isEmpty():
            parts = [p for p in parts if p.table != table] + add(seed, table, f"{table}.added")
    write_parts(spark, next_folder, parts)
    write_fingerprint(spark, next_folder)
    append_states(runs, folder, _FINISHED)
    return rows


def run_errors(spark: SparkSession, folder: str) -> DataFrame:
    """``(source_id, position, error)`` of all records that failed in the run that wrote ``folder``."""
    return error_rows(spark.read.schema("source_id int, position long, content_hash string, error string, disposition string").parquet(f"{folder.rstrip('/')}/_decided"))
