"""Join and ordering building blocks that hold when one key owns a large share of all rows.

* ``join_dimension`` - fact to dimension lookup. The dimension is broadcast only after its rows
  and bytes have been checked; beyond the bound the rows of hot keys are joined apart from all others.
* ``group_ordinals`` / ``dense_ids`` - row numbers without a window over the whole group: rows
  are range-partitioned by the full ordering, so a hot group is split over many tasks and only
  per-partition counts are combined.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
#: A key is hot with at least so many rows; of more hot keys than that the largest are set apart. So no other key holds a thousandth of all rows.
HOT_ROWS, HOT_KEYS = 100_000, 1_000
_WIDTH = 16


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Compare rows and bytes with the bounds.

    The rows of a scan are counted first (for a Parquet table Spark answers from the footers), so that a large one is not read; what is
    derived by joins or aggregation is computed once for both.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not any(node in plan for node in ("Aggregate", "Join ", "Window ")) and df.count() > max_rows:
        return False
    wide = [f for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    nested = [f for f in df.schema.fields if f.dataType.simpleString().startswith(("array", "map", "struct", "variant"))]
    sizes = [F.octet_length(F.col(f"`{f.name}`")) for f in wide] + [F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in nested]
    named = df.select(F.lit(1).alias("one"), *[size.cast("long").alias(f"s{k}") for k, size in enumerate(sizes)])
    rows, *measured = named.agg(F.count("one"), *[F.coalesce(F.sum(c), F.lit(0)) for c in named.columns[1:]]).first()
    return rows <= max_rows and rows * _WIDTH * max(1, len(df.columns)) + sum(measured) <= max_bytes


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a scan of few files; a scan with enough splits is left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def join_dimension(
    fact: DataFrame,
    dimension: DataFrame,
    on: str | list[str],
    how: str = "inner",
    *,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    fits: bool | None = None,
) -> DataFrame:
    """Join a large fact table to a dimension with unique keys; supports inner, left, left_semi, left_anti.

    ``fits`` hands over the result of an earlier :func:`fits_broadcast` of the same dimension.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(dimension, max_broadcast_rows) if fits is None else fits:
        return fact.join(F.broadcast(dimension), keys, how)
    return split_join(fact, dimension, keys, how)


def split_join(
    fact: DataFrame, dimension: DataFrame, keys: Sequence[str], how: str = "inner", *, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Shuffle join of a fact table with a dimension of unique keys, for inner, left, left_semi and left_anti, any key of which may be hot.

    Keys are counted (partly in each task), and those that hold many rows set apart: of the dimension only their rows, ``hot_keys`` at most, are
    broadcast, so their fact rows are not shuffled at all, however alike they are. Rows with a null key never match and are not shuffled either.
    Of what is left no key holds more than its share of rows. Nothing is repeated, and a task that is run again does the same.
    """
    keys = list(keys)
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(f"`{key}`").isNull()
    named = fact.filter(~empty)
    counts = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= hot_rows)
    hot = F.broadcast(counts.orderBy(F.desc("_rows"), *keys).limit(hot_keys).select(*keys))
    few = F.broadcast(dimension.join(hot, keys, "left_semi"))
    joined = named.join(hot, keys, "left_anti").join(dimension, keys, how).union(named.join(hot, keys, "left_semi").join(few, keys, how))
    if how in ("inner", "left_semi"):
        return joined
    return joined.union(fact.filter(empty).join(F.broadcast(dimension.limit(0)), keys, how))


def lookup_distinct(df: DataFrame, text: str, compute: Callable[[DataFrame], DataFrame], *, repeats: int = 4) -> DataFrame:
    """:func:`lookup_each` for one text column."""
    return lookup_each(df, {text: compute}, repeats=repeats)


def lookup_each(df: DataFrame, texts: dict[str, Callable[[DataFrame], DataFrame]], *, repeats: int = 4) -> DataFrame:
    """Add the columns that each text column's ``compute`` adds to a frame of that column alone, computed once per distinct text.

    The distinct texts with their columns are written once and joined. Where a text occurs less than ``repeats`` times on average (estimated in
    one pass for all), the columns are computed row by row. Rows without a text get nulls where texts are joined.
    """
    spark = df.sparkSession
    counts = df.agg(*[count for text in texts for count in (F.count(text), F.approx_count_distinct(text))]).first()
    out = df
    for k, (text, compute) in enumerate(texts.items()):
        rows, kinds = counts[2 * k], counts[2 * k + 1]
        if rows < repeats * kinds:
            added = [c for c in compute(df.select(text)).columns if c != text]
            out = compute(out).select(*out.columns, *added)
            continue
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
        found = compute(spread_rows(df.select(text).filter(F.col(text).isNotNull()).distinct(), kinds))
        found.write.parquet(folder)
        joined = join_dimension(out, spark.read.schema(found.schema).parquet(folder), text, "left")
        out = joined.select(*out.columns, *[c for c in found.columns if c != text])
    return out


def spread_rows(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """Deal about so many rows over all cores, for work that is expensive per row; adaptive execution joins small partitions by their bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // per_task))


def _range_positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort globally by range partitioning and fix partition id and position of every row.

    The result is checkpointed: positions feed two branches of the plan, which must see the same
    partition boundaries even when a task is run again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    partition = F.spark_partition_id()
    within = F.monotonically_increasing_id() - F.shiftleft(partition.cast("bigint"), 33)
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", partition.alias("_part"), within.alias("_pos"))
        .checkpoint()
    )


def group_ordinals(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "ordinal"
) -> DataFrame:
    """Add the 1-based rank of each row in its group, ties broken by the given order."""
    placed = _range_positions(df, [*[F.col(g) for g in group], *order])
    runs = placed.groupBy("_part", *group).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per (partition, group): a hot group has at most as many rows here as there are partitions.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    match = F.col("r._part") == F.col("o._part")
    for g in group:
        match = match & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    return placed.alias("r").join(offsets.alias("o"), match).select(
        *[F.col(f"r.`{c}`") for c in df.columns],
        (F.col("o._base") + F.col("r._pos") - F.col("o._first") + 1).alias(name),
    )


def dense_ids(df: DataFrame, order: Sequence[Column], start: int | Column = 1, name: str = "id") -> DataFrame:
    """Add consecutive ids in the given order, starting at ``start``; no single-task window over the rows."""
    placed = _range_positions(df, order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        # One row per partition, so this window is bounded by the partition count.
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    first = start if isinstance(start, Column) else F.lit(start)
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (first + F.col("_base") + F.col("_pos")).cast("bigint").alias(name)
    )
