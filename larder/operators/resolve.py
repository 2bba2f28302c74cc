"""Resolve free-text ingredient names against a catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import names as N
from larder.functions.lines import PARSED, parse_lines
from larder.functions import vocabulary as V
from larder.functions.text import normalise_title
from larder.plans.joins import join_dimension, lookup_distinct
from larder.session import ensure_checkpoint_dir


def alias_index(catalogue: DataFrame, order: str = "id") -> DataFrame:
    """``(alias, key, id)`` with one row per normalised name; the later catalogue entry wins."""
    names = F.concat(
        F.array("display_de", "display_fr", "display_it", "display_en"),
        F.coalesce("aliases", F.array().cast("array<string>")),
        F.array("key"),
    )
    return (
        catalogue.select("id", "key", F.col(order).alias("_order"), F.posexplode(names).alias("_pos", "_name"))
        .withColumn("alias", normalise_title(F.col("_name")))
        .filter("alias is not null and alias != ''")
        .groupBy("alias")
        .agg(F.max_by(F.struct("key", "id"), F.struct("_order", "_pos")).alias("entry"))
        .select("alias", "entry.key", "entry.id")
    )


def parse_texts(lines: DataFrame, line: str = "raw_text") -> DataFrame:
    """As :func:`parse_lines`, each distinct text parsed once where texts repeat."""
    base = lines.drop(*PARSED)
    parsed = lookup_distinct(base, line, lambda texts: parse_lines(texts, line))
    return parsed.withColumn("optional", F.coalesce("optional", F.lit(False)))


def resolve_names(names: DataFrame, index: DataFrame, column: str = "ingredient") -> DataFrame:
    """``(name, key, id)`` for every distinct name, null where no candidate is in the catalogue.

    Names are made distinct before candidates are built. Candidates of a name keep its
    partition, so the best one is picked without another shuffle when the index is broadcast.
    """
    distinct = names.select(F.col(column).alias("name")).distinct()
    # Staged column by column: every text is computed once per row, not once per use.
    texts = (
        distinct.withColumn("_clean", N.clean_name(F.col("name")))
        .withColumn("_low", F.lower("_clean"))
        .withColumn("_no_unit", N.without_prefix(F.col("_low"), V.QUANTITY_UNIT_PREFIX))
        .withColumn("_no_count", N.without_prefix(F.col("_low"), V.BARE_COUNT_PREFIX))
        .select(
            "name",
            F.posexplode(
                N.lookup_texts(F.col("_clean"), F.col("_low"), F.col("_no_unit"), F.col("_no_count"))
            ).alias("_round", "_raw"),
        )
        .withColumn("_t", normalise_title(F.col("_raw")))
        .withColumn("_g", N.strip_german(F.col("_t")))
        .withColumn("_c", N.strip_french_context(F.col("_t")))
        .withColumn("_cf", N.strip_french(F.col("_c")))
        .withColumn("_f", N.strip_french(F.col("_t")))
    )
    candidates = texts.select(
        "name",
        "_round",
        F.posexplode_outer(
            N.match_candidates(F.col("_t"), F.col("_g"), F.col("_c"), F.col("_cf"), F.col("_f"))
        ).alias("_rank", "alias"),
    )
    hits = join_dimension(candidates, index, "alias", "left")
    rank = F.when(F.col("key").isNotNull(), F.struct("_round", "_rank"))
    return (
        hits.groupBy("name")
        .agg(F.min_by(F.struct("key", "id"), rank).alias("entry"))
        .select("name", "entry.key", "entry.id")
    )


def resolve_lines(lines: DataFrame, index: DataFrame, column: str = "ingredient") -> DataFrame:
    """Add ``ingredient_key`` and ``ingredient_id`` to parsed lines.

    The lines are read several times, so hand over a written or checkpointed frame when parsing them is
    expensive. The mapping of distinct names is broadcast if small, else joined with
    salts, because one frequent name may occur in a large share of all lines.
    """
    found = resolve_names(lines, index, column).select(
        F.col("name").alias(column), F.col("key").alias("ingredient_key"), F.col("id").alias("ingredient_id")
    )
    # written once: their number decides on the join, and the join reads them again
    folder = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/names-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    found = lines.sparkSession.read.schema(found.schema).parquet(folder)
    base = lines.drop("ingredient_key", "ingredient_id")
    return join_dimension(base, found, column, "left")

