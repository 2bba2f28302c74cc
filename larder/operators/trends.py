"""Cooking statistics: trends by period, most cooked recipes, denormalised recipe stats, collection stats."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.search import top, with_titles
from larder.plans.joins import join_dimension


def monday_week(day: Column) -> Column:
    """``YYYY-Www`` with weeks from Monday; days before the first Monday are week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    return F.concat(F.date_format(day, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def _per_period(cook_log: DataFrame, period: Column, since: Column) -> DataFrame:
    return (
        cook_log.filter(F.col("cooked_on") >= since)
        .groupBy(period.alias("period"))
        .agg(F.count(F.lit(1)).alias("cook_count"), F.count_distinct("recipe_id").alias("unique_recipes"))
        .orderBy("period")
    )


def weekly_trends(cook_log: DataFrame, as_of: date, weeks: int = 12) -> DataFrame:
    """Cook events and distinct recipes per week over the last weeks."""
    return _per_period(cook_log, monday_week(F.col("cooked_on")), F.date_sub(F.lit(as_of), 7 * weeks))


def monthly_trends(cook_log: DataFrame, as_of: date, months: int = 6) -> DataFrame:
    """Cook events and distinct recipes per month over the last months."""
    return _per_period(
        cook_log, F.date_format("cooked_on", "yyyy-MM"), F.add_months(F.lit(as_of), -months)
    )


def top_recipes(cook_log: DataFrame, recipes: DataFrame, limit: int | None = 10) -> DataFrame:
    """Most cooked recipes with their last date; events are counted before titles are joined."""
    counts = cook_log.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("cook_count"), F.max("cooked_on").alias("last_cooked")
    )
    order = [F.col("cook_count").desc(), F.col("recipe_id")]
    return with_titles(top(counts, order, limit), recipes, limit).select(
        "recipe_id", "title", "cook_count", "last_cooked"
    ).orderBy(*order)


def cooking_frequency(
    cook_log: DataFrame, recipes: DataFrame, as_of: date, granularity: str = "weekly", periods: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Trend and five most cooked recipes."""
    if granularity == "monthly":
        trend = monthly_trends(cook_log, as_of, periods or 6)
    else:
        trend = weekly_trends(cook_log, as_of, periods or 12)
    return trend, top_recipes(cook_log, recipes, 5)


def cook_stats(cook_log: DataFrame) -> DataFrame:
    """Per recipe: number of events, last date, latest rating that was given."""
    rated = F.when(F.col("rating").isNotNull(), F.struct("cooked_on", "logged_at", "id"))
    return cook_log.groupBy("recipe_id").agg(
        F.count(F.lit(1)).alias("times_cooked"),
        F.max("cooked_on").alias("last_cooked_on"),
        F.max_by("rating", rated).alias("latest_rating"),
    )


def cook_history(
    cook_log: DataFrame, recipes: DataFrame, recipe_id: int | None = None, limit: int | None = 10
) -> DataFrame:
    """Latest cook events of known recipes, newest first."""
    events = cook_log.select("id", "recipe_id", "cooked_on", "servings", "rating", "notes", "logged_at")
    if recipe_id is not None:
        events = events.filter(F.col("recipe_id") == recipe_id)
    titles = recipes.select(F.col("id").alias("recipe_id"), "title")
    # Reduced to known recipes before the top-k; recipe ids are unique, so no row is repeated.
    known = join_dimension(events, titles, "recipe_id")
    order = [F.col("cooked_on").desc_nulls_last(), F.col("logged_at").desc_nulls_last(), F.col("id").desc()]
    return top(known, order, limit)


def collection_stats(recipes: DataFrame) -> DataFrame:
    """One row: totals, conditional counts, average time, distinct languages and courses."""
    return recipes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "deleted").alias("deleted"),
        F.count_if("starred").alias("starred"),
        F.avg("total_minutes").alias("avg_minutes"),
        F.count_distinct("language").alias("languages"),
        F.count_distinct("course").alias("courses"),
    )
