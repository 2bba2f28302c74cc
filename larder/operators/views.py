"""Ready-made joins of recipes and lines with what belongs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.trends import cook_stats
from larder.plans.joins import join_dimension


def recipe_full(recipes: DataFrame, cook_log: DataFrame, recipe_images: DataFrame) -> DataFrame:
    """Recipes with the statistics of their cook log and their first image; both sides are reduced to a row per recipe first.

    The columns ``times_cooked`` and ``last_cooked_at`` of the recipe stay; the log's are ``log_times_cooked`` (0 without
    events), ``log_last_cooked_on`` and ``log_latest_rating``. ``primary_image`` is the URL of the lowest ``seq``.
    """
    stats = cook_stats(cook_log).select("recipe_id", *[F.col(c).alias(f"log_{c}") for c in ("times_cooked", "last_cooked_on", "latest_rating")])
    image = recipe_images.groupBy("recipe_id").agg(F.min_by("url", F.struct("seq", "url")).alias("primary_image"))
    full = recipes.join(stats.withColumnRenamed("recipe_id", "id"), "id", "left")
    full = full.join(image.withColumnRenamed("recipe_id", "id"), "id", "left")
    return full.withColumn("log_times_cooked", F.coalesce("log_times_cooked", F.lit(0)))


def ingredients_resolved(recipe_ingredients: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Ingredient lines with key, names and category of their catalogue entry, null where they have none."""
    named = [c for c in ("key", "display_de", "display_fr", "display_it", "display_en", "category") if c in ingredients.columns]
    entries = ingredients.select(F.col("id").alias("ingredient_id"), *[F.col(c).alias(f"ingredient_{c}") for c in named])
    return join_dimension(recipe_ingredients, entries, "ingredient_id", "left")
