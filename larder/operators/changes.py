"""Apply change tables to the knowledge base: each function returns the new state of a table.

Changes to one key are reduced to the latest before the join, so both sides have unique keys and a
key that is changed very often is combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.durations import own_total
from larder.functions.lines import parse_lines
from larder.functions.text import normalise_title, strip
from larder.operators.trends import cook_stats
from larder.plans.joins import dense_ids, join_dimension

RATING_RANGE = (1, 5)


def max_id(table: DataFrame, column: str = "id") -> int:
    """Largest id, 0 for an empty table."""
    return int(table.agg(F.max(column)).first()[0] or 0)


def latest(changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest values per key."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_v")).select(
        key, *[F.col(f"_v.{c}").alias(c) for c in columns]
    )


def apply_updates(
    current: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Set ``columns`` of the rows whose key is in ``changes`` (a null sets null)."""
    reduced = latest(changes, key, columns, order) if order else changes.select(key, *columns)
    values = reduced.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed")
    )
    types = {f.name: f.dataType for f in current.schema.fields}
    return current.join(values, key, "left").select(
        *[
            F.when(F.col("_changed"), F.col(f"_new_{c}").cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in current.columns
        ]
    )


def star_recipes(recipes: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(recipe_id, starred, changed_at)``."""
    return apply_updates(
        recipes, changes.withColumnRenamed("recipe_id", "id"), "id", ["starred"], ["changed_at", "starred"]
    )


def valid_rating(rating: Column) -> Column:
    return rating.isNull() | rating.between(*RATING_RANGE)


def rate_recipes(recipes: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes(recipe_id, owner_rating, changed_at)``; null clears, other values must be 1 to 5."""
    valid = changes.filter(valid_rating(F.col("owner_rating"))).withColumnRenamed("recipe_id", "id")
    return apply_updates(recipes, valid, "id", ["owner_rating"], ["changed_at", "owner_rating"])


class CookLogResult(NamedTuple):
    cook_log: DataFrame
    recipes: DataFrame
    pins: DataFrame | None
    rejected: DataFrame


def log_cooks(
    cook_log: DataFrame, recipes: DataFrame, events: DataFrame, as_of: date, pins: DataFrame | None = None
) -> CookLogResult:
    """Append cook events, refresh the stats of affected recipes, close their open pins.

    Events of unknown recipes and ratings outside 1 to 5 are rejected with a reason. ``events`` has
    the cook-log columns except ``id``.
    """
    known = recipes.select(F.col("id").alias("recipe_id"), F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "unknown recipe").when(
        ~valid_rating(F.col("rating")), "rating out of range"
    )
    checked = (
        join_dimension(events, known, "recipe_id", "left")
        .withColumn("reason", reason)
        .withColumn("cooked_on", F.coalesce("cooked_on", F.lit(as_of)))
        .drop("_known")
    )
    valid = checked.filter("reason is null").drop("reason")
    order = [F.col(c).asc_nulls_last() for c in ("logged_at", "recipe_id", "cooked_on")]
    added = dense_ids(valid, order, max_id(cook_log) + 1)
    full = cook_log.unionByName(added.select(*cook_log.columns))

    affected = valid.select("recipe_id").distinct()
    # Events become one row per recipe first, so a recipe with very many is no hot spot of the join.
    stats = cook_stats(full).join(affected, "recipe_id", "left_semi")
    updates = recipes.select("id", "owner_rating").join(
        stats.withColumnRenamed("recipe_id", "id"), "id"
    ).select(
        "id",
        "times_cooked",
        F.col("last_cooked_on").alias("last_cooked_at"),
        F.coalesce("latest_rating", "owner_rating").alias("owner_rating"),
    )
    new_recipes = apply_updates(recipes, updates, "id", ["times_cooked", "last_cooked_at", "owner_rating"])
    new_pins = None if pins is None else close_pins(pins, affected, "cooked")
    return CookLogResult(full, new_recipes, new_pins, checked.filter("reason is not null"))


def close_pins(pins: DataFrame, recipe_ids: DataFrame, status: str) -> DataFrame:
    """Move the open pins of the given recipes to ``cooked`` or ``dismissed``."""
    hits = recipe_ids.select("recipe_id").distinct().withColumn("_hit", F.lit(True))
    return join_dimension(pins, hits, "recipe_id", "left").select(
        *[
            F.when(F.col("_hit") & (F.col("status") == "pinned"), status).otherwise(F.col("status")).alias("status")
            if c == "status"
            else F.col(c)
            for c in pins.columns
        ]
    )


def pin_recipes(pins: DataFrame, recipes: DataFrame, requests: DataFrame) -> DataFrame:
    """Add ``requests(recipe_id, pinned_at, target_date, note)`` of known recipes without an open pin."""
    first = requests.groupBy("recipe_id").agg(
        F.min_by(F.struct("pinned_at", "target_date", "note"), F.struct("pinned_at", "target_date", "note")).alias("_r")
    )
    open_pins = pins.filter("status = 'pinned'").select("recipe_id").distinct()
    fresh = (
        first.join(recipes.select(F.col("id").alias("recipe_id")), "recipe_id", "left_semi")
        .join(open_pins, "recipe_id", "left_anti")
        .select("recipe_id", "_r.*", F.lit("pinned").alias("status"))
    )
    added = dense_ids(fresh, [F.col("pinned_at"), F.col("recipe_id")], max_id(pins) + 1)
    types = {f.name: f.dataType for f in pins.schema.fields}
    return pins.unionByName(added.select(*[F.col(c).cast(types[c]).alias(c) for c in pins.columns]))


def list_pins(pins: DataFrame, recipes: DataFrame, include_done: bool = False) -> DataFrame:
    """Pins with titles: planned dates first, undated last."""
    df = pins if include_done else pins.filter("status = 'pinned'")
    titles = recipes.select(F.col("id").alias("recipe_id"), "title")
    return (
        join_dimension(df, titles, "recipe_id")
        .select("id", "recipe_id", "title", "pinned_at", "target_date", "note", "status")
        .orderBy(F.col("target_date").asc_nulls_last(), F.col("pinned_at").asc_nulls_last(), F.col("id"))
    )


class PantryResult(NamedTuple):
    pantry: DataFrame
    unknown: DataFrame


def update_pantry(
    pantry: DataFrame, ingredients: DataFrame, additions: DataFrame, removals: DataFrame
) -> PantryResult:
    """Upsert ``additions(key, approx_quantity, unit, location, updated_at, note)``, then drop ``removals(key)``.

    The latest addition per ingredient wins. Keys that are not in the catalogue are reported.
    """
    keys = ingredients.select(F.col("id").alias("ingredient_id"), "key")
    columns = [c for c in pantry.columns if c != "ingredient_id"]
    order = ["updated_at", *[c for c in columns if c != "updated_at"]]
    added = latest(additions, "key", columns, order).join(keys, "key", "left")
    gone = removals.select("key").distinct().join(keys, "key", "left")
    upserts = latest(added.filter("ingredient_id is not null"), "ingredient_id", columns, order)
    kept = pantry.join(upserts.select("ingredient_id"), "ingredient_id", "left_anti")
    merged = kept.unionByName(upserts.select(*pantry.columns))
    remaining = merged.join(gone.filter("ingredient_id is not null").select("ingredient_id"), "ingredient_id", "left_anti")
    unknown = (
        added.filter("ingredient_id is null").select("key").unionByName(gone.filter("ingredient_id is null").select("key"))
    ).distinct()
    return PantryResult(remaining.select(*pantry.columns), unknown)


class OwnRecipes(NamedTuple):
    recipes: DataFrame
    recipe_ingredients: DataFrame
    recipe_steps: DataFrame
    rejected: DataFrame


def add_own_recipes(recipes: DataFrame, entries: DataFrame, source_id: int) -> OwnRecipes:
    """Rows for hand-entered recipes.

    ``entries`` has ``entry_no, title, ingredients, steps, servings, prep_minutes, cook_minutes,
    difficulty, entered_at``. Entries without title, ingredients or steps are rejected.
    """
    reason = (
        F.when(strip(F.coalesce("title", F.lit(""))) == "", "title is required")
        .when(F.coalesce(F.size("ingredients"), F.lit(0)) < 1, "ingredients are required")
        .when(F.coalesce(F.size("steps"), F.lit(0)) < 1, "steps are required")
    )
    checked = entries.withColumn("reason", reason)
    valid = dense_ids(
        checked.filter("reason is null").drop("reason"), [F.col("entry_no")], max_id(recipes) + 1
    )
    rows = valid.select(
        F.col("id"),
        F.lit(source_id).alias("source_id"),
        F.concat(F.lit("own-"), F.col("id").cast("string")).alias("source_external_id"),
        strip(F.col("title")).alias("title"),
        normalise_title(F.col("title")).alias("title_normalised"),
        "servings",
        "prep_minutes",
        "cook_minutes",
        own_total(F.col("prep_minutes"), F.col("cook_minutes")).alias("total_minutes"),
        "difficulty",
        F.array().cast("array<string>").alias("original_keywords"),
        F.lit(False).alias("starred"),
        F.lit(0).alias("times_cooked"),
        F.col("entered_at").alias("scraped_at"),
        F.col("entered_at").alias("updated_at"),
        F.lit("active").alias("status"),
    )
    lines = parse_lines(
        valid.select(F.col("id").alias("recipe_id"), F.posexplode("ingredients").alias("_pos", "raw_text"))
    ).select(
        "recipe_id",
        (F.col("_pos") + 1).alias("seq"),
        "raw_text",
        "quantity",
        "unit",
        "prep_note",
        F.lit(False).alias("optional"),
    )
    steps = valid.select(F.col("id").alias("recipe_id"), F.posexplode("steps").alias("_pos", "text")).select(
        "recipe_id", (F.col("_pos") + 1).alias("step_no"), "text"
    )
    return OwnRecipes(rows, lines, steps, checked.filter("reason is not null"))
