"""Table scans and sinks over a folder of Parquet tables, checked against the registry."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.errors import DataStaleError, SchemaError
from larder.operators.classify import computed_tags
from larder.schemas import SCHEMAS, registry_fingerprint, schema_for

FINGERPRINT_TABLE = "_schema_version"
PARTS_TABLE = "_parts"


def table_path(folder: str, table: str) -> str:
    return f"{folder.rstrip('/')}/{table}.parquet"


class Part(NamedTuple):
    """A folder of files that belongs to a table; ``source_id`` when it holds rows of that source only."""

    table: str
    path: str
    source_id: int | None = None


def write_parts(spark: SparkSession, folder: str, parts: Sequence[Part]) -> None:
    """List the parts of a data folder's tables, also those that lie in earlier folders. A few rows per run and table."""
    lines = [(json.dumps(part._asdict()),) for part in parts]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/{PARTS_TABLE}")


def read_parts(spark: SparkSession, folder: str) -> list[Part]:
    """The listed parts; none for a folder that holds all its tables itself."""
    if not _is_there(spark, "text", f"{folder.rstrip('/')}/{PARTS_TABLE}"):
        return []
    return [Part(**json.loads(row.value)) for row in spark.read.text(f"{folder.rstrip('/')}/{PARTS_TABLE}").collect()]


def table_parts(spark: SparkSession, folder: str, table: str) -> list[Part]:
    """Where the rows of a table lie: the folder's own files, and the parts that it lists."""
    own = [Part(table, table_path(folder, table))] if _is_there(spark, "parquet", table_path(folder, table)) else []
    return own + [part for part in read_parts(spark, folder) if part.table == table]


def _is_there(spark: SparkSession, form: str, path: str) -> bool:
    """Ask Spark's own file index, so that any file system Spark can read works."""
    try:
        spark.read.format(form).schema("value string").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def table_exists(spark: SparkSession, folder: str, table: str) -> bool:
    return bool(table_parts(spark, folder, table))


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Typed scan of one registered table."""
    schema = schema_for(table)
    parts = table_parts(spark, folder, table)
    if not parts:
        raise DataStaleError(f"no data for table {table!r} under {folder}")
    return spark.read.schema(schema).parquet(*[part.path for part in parts])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Order and cast columns to the registry, fill missing ones with null, refuse unknown ones."""
    schema = schema_for(table)
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise SchemaError(f"columns not in table {table!r}: {', '.join(unknown)}")
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_table(df: DataFrame, folder: str, table: str) -> str:
    """Replace a table. Never pass a frame that reads the same path: write to a new folder instead."""
    path = table_path(folder, table)
    conform(df, table).write.mode("overwrite").parquet(path)
    return path


def append_table(df: DataFrame, folder: str, table: str) -> str:
    """Add rows as new files; existing files are left alone."""
    path = table_path(folder, table)
    conform(df, table).write.mode("append").parquet(path)
    return path


def with_computed_tags(recipes: DataFrame) -> DataFrame:
    """Recipes plus the virtual ``computed_tags`` array; pruned away when nobody selects it."""
    return recipes.withColumn("computed_tags", computed_tags())


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """Register a temporary view for every table that exists; ``recipes`` gets ``computed_tags``."""
    check_fingerprint(spark, folder)
    registered = []
    for table in SCHEMAS:
        if table_exists(spark, folder, table):
            df = read_table(spark, folder, table)
            (with_computed_tags(df) if table == "recipes" else df).createOrReplaceTempView(table)
            registered.append(table)
    return registered


def seed_empty_tables(spark: SparkSession, folder: str) -> list[str]:
    """Write an empty typed table for every registered table that is missing."""
    created = []
    for table, schema in SCHEMAS.items():
        if not table_exists(spark, folder, table):
            spark.createDataFrame([], schema).write.parquet(table_path(folder, table))
            created.append(table)
    return created


def seed_if_empty(df: DataFrame, folder: str, table: str) -> bool:
    """Fill a dimension table (sources, ingredient catalogue) unless it already has rows."""
    spark = df.sparkSession
    if table_exists(spark, folder, table) and not read_table(spark, folder, table).isEmpty():
        return False
    write_table(df, folder, table)
    return True


def write_fingerprint(spark: SparkSession, folder: str) -> str:
    """Store the registry fingerprint next to the data."""
    fingerprint = registry_fingerprint()
    line = json.dumps({"schema_hash": fingerprint, "entity_count": len(SCHEMAS)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{folder.rstrip('/')}/{FINGERPRINT_TABLE}"
    )
    return fingerprint


def read_fingerprint(spark: SparkSession, folder: str) -> str | None:
    """Stored fingerprint, or null when there is none."""
    try:
        stored = spark.read.text(f"{folder.rstrip('/')}/{FINGERPRINT_TABLE}")
    except AnalysisException:
        return None
    row = stored.select(F.get_json_object("value", "$.schema_hash").alias("h")).first()
    return row.h if row else None


def check_fingerprint(spark: SparkSession, folder: str) -> None:
    """Refuse data written with another registry; a missing fingerprint is accepted."""
    stored = read_fingerprint(spark, folder)
    if stored is not None and stored != registry_fingerprint():
        raise DataStaleError("the data was written with a different schema; rebuild it")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` for the given frames."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """``(table, rows)`` for every registered table, null where there is no data."""
    parts = []
    for table in sorted(SCHEMAS):
        if table_exists(spark, folder, table):
            parts.append(table_counts({table: read_table(spark, folder, table)}))
        else:
            parts.append(spark.range(1).select(F.lit(table).alias("table"), F.lit(None).cast("bigint").alias("rows")))
    return reduce(DataFrame.unionByName, parts)
