"""Data-quality checks; every check yields ``(check, key, detail)`` rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import SCHEMAS, registry_fingerprint
from larder.sources.tables import read_fingerprint, read_table, table_exists

# Tables that must exist.
CORE_TABLES = ["recipes", "recipe_ingredients", "recipe_steps", "sources"]
#: Keys of parent rows that a task compares.
TASK_KEYS = 500_000


def missing_required(df: DataFrame, key: str, columns: Sequence[str], check: str = "required_fields") -> DataFrame:
    """Rows in which a required column is null, or an empty string."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    faults = [
        F.when(F.col(c).isNull() | (F.col(c) == "") if c in text else F.col(c).isNull(), c) for c in columns
    ]
    return (
        df.select(F.col(key).cast("string").alias("key"), F.array_compact(F.array(*faults)).alias("f"))
        .filter(F.size("f") > 0)
        .select(F.lit(check).alias("check"), "key", F.array_join("f", ",").alias("detail"))
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, check: str) -> DataFrame:
    """Distinct foreign keys without a parent row. Keys are made distinct before the join.

    Both sides are shuffled and merged: files of keys are so small that Spark would broadcast all of them to every task. Tasks get about
    TASK_KEYS parents each, whatever their bytes.
    """
    parents = parent.select(F.col(pk).alias("_k"))
    tasks = 1 + parents.count() // TASK_KEYS
    keys = child.select(F.col(fk).alias("_k")).distinct().repartition(tasks, "_k")
    return keys.join(parents.repartition(tasks, "_k").hint("merge"), "_k", "left_anti").select(
        F.lit(check).alias("check"), F.col("_k").cast("string").alias("key"), F.lit(fk).alias("detail")
    )


def duplicates(df: DataFrame, keys: Sequence[str], check: str = "duplicates") -> DataFrame:
    """Key combinations that occur more than once, with their count."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(
            F.lit(check).alias("check"),
            F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]).alias("key"),
            F.col("n").cast("string").alias("detail"),
        )
    )


def validate_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """All checks over the tables that are given."""
    parts = []
    recipes = tables.get("recipes")
    if recipes is not None:
        parts.append(missing_required(recipes, "id", ["title", "source_id"], "recipe_required_fields"))
        for child in ("recipe_ingredients", "recipe_steps", "cook_log"):
            if child in tables:
                parts.append(orphans(tables[child], recipes, "recipe_id", "id", f"{child}_fk"))
        parts.append(duplicates(recipes, ["source_id", "source_external_id"], "duplicate_recipes"))
    return reduce(DataFrame.unionByName, parts)


def validate(spark: SparkSession, folder: str) -> DataFrame:
    """Missing core tables and all checks over a data folder."""
    present = {t: read_table(spark, folder, t) for t in SCHEMAS if table_exists(spark, folder, t)}
    missing = [("table_exists", t, "missing") for t in CORE_TABLES if t not in present]
    issues = spark.createDataFrame(missing, "check string, key string, detail string")
    return issues.unionByName(validate_tables(present)) if "recipes" in present else issues


def doctor(spark: SparkSession, folder: str) -> DataFrame:
    """``(check, severity, detail)``: which tables are present and whether the stored schema still fits."""
    present = [t for t in sorted(SCHEMAS) if table_exists(spark, folder, t)]
    missing = [t for t in sorted(SCHEMAS) if t not in present]
    if not present:
        tables = ("tables", "warn", "no tables found")
    elif missing:
        tables = ("tables", "warn", f"{len(present)} present, {len(missing)} missing: {', '.join(missing)}")
    else:
        tables = ("tables", "ok", f"all {len(present)} tables present")
    stored, current = read_fingerprint(spark, folder), registry_fingerprint()
    if stored is None:
        schema = ("schema_version", "warn", "no stored fingerprint")
    elif stored != current:
        schema = ("schema_version", "error", f"data {stored[:8]}, code {current[:8]}")
    else:
        schema = ("schema_version", "ok", current[:8])
    return spark.createDataFrame([tables, schema], "check string, severity string, detail string")


def schema_drift(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """``(table, column, expected, found)`` for every column whose type differs from the registry."""
    drift = []
    for table, df in tables.items():
        found = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        expected = {f.name: f.dataType.simpleString() for f in SCHEMAS[table].fields}
        for column in sorted(found.keys() | expected.keys()):
            if found.get(column) != expected.get(column):
                drift.append((table, column, expected.get(column, "-"), found.get(column, "-")))
    return drift
