"""Recommenders: pantry coverage, rotation, quick and easy."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.operators.search import top
from larder.plans.joins import MAX_BROADCAST_ROWS, fits_broadcast, join_dimension
from larder.session import ensure_checkpoint_dir


def available_keys(
    pantry: DataFrame,
    ingredients: DataFrame,
    extras: Sequence[str] = (),
    staples: Sequence[str] = tuple(V.PANTRY_STAPLES),
) -> DataFrame:
    """Distinct keys at hand: pantry contents, extras and staples."""
    keys = ingredients.select(F.col("id").alias("ingredient_id"), "key").filter("key is not null and key != ''")
    stocked = keys.join(pantry.select("ingredient_id").distinct(), "ingredient_id", "left_semi").select("key")
    given = [(k,) for k in {*extras, *staples}]
    if given:
        stocked = stocked.unionByName(pantry.sparkSession.createDataFrame(given, "key string"))
    return stocked.distinct()


def part_keys(recipe_ingredients: DataFrame, ingredients: DataFrame, fits: bool | None = None) -> DataFrame:
    """``(recipe_id, seq, key)``: catalogue key of each line, else its lower-case text."""
    keys = ingredients.select(F.col("id").alias("ingredient_id"), "key")
    return (
        join_dimension(recipe_ingredients, keys, "ingredient_id", "left", fits=fits)
        .withColumn("key", F.coalesce("key", F.lower("raw_text")))
        .filter("key is not null and key != ''")
    )


def pantry_coverage(parts: DataFrame, available: DataFrame, fits: bool | None = None) -> DataFrame:
    """Per recipe: number of parts, covered parts and missing parts; repeated parts count each time."""
    at_hand = available.select("key", F.lit(True).alias("at_hand"))
    return (
        join_dimension(parts.select("recipe_id", "key"), at_hand, "key", "left", fits=fits)
        .groupBy("recipe_id")
        .agg(F.count(F.lit(1)).alias("ingredient_count"), F.count("at_hand").alias("covered"))
        .withColumn("missing", F.col("ingredient_count") - F.col("covered"))
    )


def suggest_for_pantry(
    recipes: DataFrame,
    recipe_ingredients: DataFrame,
    ingredients: DataFrame,
    pantry: DataFrame,
    *,
    extras: Sequence[str] = (),
    staples: Sequence[str] = tuple(V.PANTRY_STAPLES),
    missing_ok: int = 2,
    max_total_minutes: int | None = None,
    limit: int | None = 5,
    line_order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Active recipes by the share of their parts that are at hand.

    Lines are first reduced to three counts per recipe (partial aggregation, so one huge recipe is
    no hot spot). Of missing parts a task passes on the first ``missing_ok`` of a recipe, which is all that a winner has.
    """
    candidates = recipes.filter("status = 'active'")
    if max_total_minutes is not None:
        candidates = candidates.filter(F.col("total_minutes") <= max_total_minutes)
    candidates = candidates.select(F.col("id").alias("recipe_id"), "title", "total_minutes")

    ensure_checkpoint_dir(recipes.sparkSession)
    # Both are small next to the lines and used more than once, so each is computed once.
    available = available_keys(pantry, ingredients, extras, staples).checkpoint()
    few_keys, few_available = fits_broadcast(ingredients), fits_broadcast(available)
    lines = recipe_ingredients.select("recipe_id", "ingredient_id", "raw_text", *line_order)
    coverage = F.round(F.col("covered") / F.col("ingredient_count"), 3)
    scored = (
        pantry_coverage(part_keys(lines, ingredients, few_keys), available, few_available)
        .filter(F.col("missing") <= missing_ok)
        .join(candidates, "recipe_id")
        .withColumn("coverage_score", coverage)
        .withColumn("score", F.round(F.col("coverage_score") - F.col("missing") * F.lit(0.1), 3))
    )
    winners = scored if limit is None else top(scored, [F.col("score").desc(), F.col("recipe_id")], limit)
    winners = winners.checkpoint()

    # Lines are read again for their missing parts alone. A small limit bounds the winners, and with them the broadcast; without one
    # each task passes on the first missing parts of a recipe only, as many as a winner may have, so no recipe is a hot key.
    open_lines = lines
    if limit is not None and limit <= MAX_BROADCAST_ROWS:
        open_lines = lines.join(F.broadcast(winners.filter("missing > 0").select("recipe_id")), "recipe_id", "left_semi")
    first = Window.partitionBy("recipe_id").orderBy(*line_order, "key")
    gaps = (
        join_dimension(part_keys(open_lines, ingredients, few_keys), available, "key", "left_anti", fits=few_available)
        .select("recipe_id", *line_order, "key", F.row_number().over(first).alias("_place"))
        .filter(F.col("_place") <= missing_ok)
        .groupBy("recipe_id")
        .agg(F.array_sort(F.collect_list(F.struct(*line_order, "key"))).alias("_gaps"))
        .select("recipe_id", F.transform("_gaps", lambda g: g["key"]).alias("missing_ingredients"))
    )
    return (
        winners.join(gaps, "recipe_id", "left")
        .select(
            F.col("recipe_id").alias("id"),
            "title",
            "total_minutes",
            "ingredient_count",
            "covered",
            "missing",
            F.coalesce("missing_ingredients", F.array().cast("array<string>")).alias("missing_ingredients"),
            "coverage_score",
            "score",
        )
        .orderBy(F.col("score").desc(), "id")
    )


def freshness(days_since: Column, after_days: int) -> Column:
    """1 when never cooked, 0 when recent, else growing with the days up to 1."""
    return (
        F.when(days_since.isNull(), 1.0)
        .when(days_since >= after_days, F.least(F.lit(1.0), days_since / F.lit(float(after_days * 2))))
        .otherwise(0.0)
    )


def suggest_rotation(
    recipes: DataFrame, as_of: date, *, min_rating: int = 4, not_cooked_in_days: int = 90, limit: int | None = 5
) -> DataFrame:
    """Well-rated active recipes that were not cooked lately, ranked by score; all of them are scored."""
    rated = recipes.filter((F.col("owner_rating") >= min_rating) & (F.col("status") == "active")).select(
        "id", "title", "owner_rating", "times_cooked", "last_cooked_at"
    )
    order = [F.col("owner_rating").desc(), F.col("last_cooked_at").asc_nulls_first(), F.col("id")]
    days = F.datediff(F.lit(as_of), F.col("last_cooked_at").cast("date"))
    score = (F.col("owner_rating") - 1) / F.lit(4.0) * F.lit(0.6) + freshness(
        F.col("days_since_cooked"), not_cooked_in_days
    ) * F.lit(0.4)
    return top(
        rated.withColumn("days_since_cooked", days).withColumn("score", F.round(score, 3)),
        [F.col("score").desc(), *order],
        limit,
    )


def suggest_easy(
    recipes: DataFrame,
    recipe_ingredients: DataFrame,
    as_of: date,
    *,
    max_total_minutes: int = 30,
    max_ingredients: int = 8,
    avoid_recent_days: int = 14,
    limit: int | None = 5,
) -> DataFrame:
    """Quick active recipes with few parts; fast, simple, not recently cooked and easy ones first.

    Lines are counted per recipe before the join, so recipes without lines stay and no line is
    shuffled twice.
    """
    counts = recipe_ingredients.groupBy("recipe_id").agg(F.count(F.lit(1)).alias("ingredient_count"))
    quick = recipes.filter((F.col("total_minutes") <= max_total_minutes) & (F.col("status") == "active")).select(
        F.col("id").alias("recipe_id"), "title", "total_minutes", "difficulty", "last_cooked_at"
    )
    zero = F.lit(0.0)
    minutes = F.when(F.col("total_minutes") == 0, max_total_minutes).otherwise(F.col("total_minutes"))
    speed = F.greatest(zero, 1 - minutes / F.lit(float(max_total_minutes))) if max_total_minutes else zero
    simplicity = (
        F.greatest(zero, 1 - F.col("ingredient_count") / F.lit(float(max_ingredients))) if max_ingredients else zero
    )
    cutoff = F.date_sub(F.lit(as_of), avoid_recent_days)
    rested = (
        F.when(F.col("last_cooked_at").isNull(), 0.5)
        .when(F.col("last_cooked_at").cast("date") < cutoff, 0.3)
        .otherwise(0.0)
    )
    level = F.when(F.col("difficulty") == "easy", 0.2).when(F.col("difficulty") == "advanced", -0.2).otherwise(0.0)
    scored = (
        quick.join(counts, "recipe_id", "left")
        .withColumn("ingredient_count", F.coalesce("ingredient_count", F.lit(0)))
        .filter(F.col("ingredient_count") <= max_ingredients)
        .withColumn("score", F.round(speed + simplicity + rested + level, 3))
        .select(
            F.col("recipe_id").alias("id"),
            "title",
            "total_minutes",
            "difficulty",
            "ingredient_count",
            "last_cooked_at",
            "score",
        )
    )
    return top(scored, [F.col("score").desc(), F.col("id")], limit)


def pairing_tags(ingredients: DataFrame, recipe_ingredients: DataFrame) -> DataFrame:
    """Distinct ``(recipe_id, tag)`` from the tags of a recipe's ingredients."""
    tags = ingredients.select(F.col("id").alias("ingredient_id"), "pairing_tags")
    return (
        join_dimension(recipe_ingredients.select("recipe_id", "ingredient_id"), tags, "ingredient_id")
        .select("recipe_id", F.explode("pairing_tags").alias("tag"))
        .distinct()
    )


def suggest_by_tags(
    recipes: DataFrame, tags: DataFrame, wanted: Sequence[str], limit: int | None = 5
) -> DataFrame:
    """Active recipes by how many of the wanted pairing tags they have."""
    overlap = (
        tags.filter(F.col("tag").isin(sorted(set(wanted))))
        .groupBy("recipe_id")
        .agg(F.count(F.lit(1)).alias("overlap"))
    )
    active = recipes.filter("status = 'active'").select(F.col("id").alias("recipe_id"), "title")
    return top(overlap.join(active, "recipe_id"), [F.col("overlap").desc(), F.col("recipe_id")], limit)


def shopping_list(
    recipe_ingredients: DataFrame, ingredients: DataFrame, plan: DataFrame, pantry: DataFrame
) -> DataFrame:
    """What to buy for ``plan(recipe_id, scale)``: scaled sums per ingredient and unit minus the pantry."""
    lines = recipe_ingredients.select("recipe_id", "ingredient_id", "quantity", "unit")
    need = (
        join_dimension(lines, plan.groupBy("recipe_id").agg(F.sum("scale").alias("scale")), "recipe_id")
        .filter("ingredient_id is not null")
        .groupBy("ingredient_id", "unit")
        .agg(F.sum(F.col("quantity") * F.col("scale")).alias("needed"))
    )
    stock = pantry.groupBy("ingredient_id", "unit").agg(F.sum("approx_quantity").alias("in_stock"))
    names = ingredients.select(F.col("id").alias("ingredient_id"), "key", "category")
    same = (need["ingredient_id"] == stock["ingredient_id"]) & need["unit"].eqNullSafe(stock["unit"])
    return (
        need.join(stock, same, "left")
        .select(need["ingredient_id"], need["unit"], "needed", F.coalesce("in_stock", F.lit(0.0)).alias("in_stock"))
        .withColumn("to_buy", F.greatest(F.col("needed") - F.col("in_stock"), F.lit(0.0)))
        .filter("to_buy > 0 or needed is null")
        .join(names, "ingredient_id", "left")
    )
