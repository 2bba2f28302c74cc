"""Promotions: filters, validity, discounts, ingredient links and best offers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.search import top
from larder.plans.joins import join_dimension



def _by_discount() -> list[Column]:
    return [F.col("discount_pct").desc_nulls_last(), F.col("id")]


def discount_pct(regular: Column, price: Column) -> Column:
    """Discount in percent; null without a positive regular price."""
    return F.when(regular > 0, (regular - price) / regular * 100)


def find_promotions(
    promotions: DataFrame,
    retailers: DataFrame | None = None,
    *,
    retailer: str | None = None,
    product: str | None = None,
    min_discount_pct: float = 0.0,
    limit: int | None = 50,
) -> DataFrame:
    """Promotions by discount, optionally of one retailer and with a product name part (any case)."""
    df = promotions
    if min_discount_pct > 0:
        df = df.filter(F.col("discount_pct") >= float(min_discount_pct))
    if product:
        df = df.filter(F.lower("product_name").contains(product.lower()))
    if retailer:
        ids = retailers.filter(F.col("key") == retailer).select(F.col("id").alias("retailer_id")).distinct()
        df = join_dimension(df, ids, "retailer_id", "left_semi")
    return top(
        df.select(
            "id", "product_name", "brand", "price_chf", "regular_price_chf", "discount_pct", "valid_from", "valid_to"
        ),
        _by_discount(),
        limit,
    )


def unexpired(promotions: DataFrame, as_of: date, limit: int | None = 50) -> DataFrame:
    """Promotions that have not ended on the given day, by discount."""
    df = promotions.filter(F.col("valid_to") >= F.lit(as_of)).select(
        "id", "product_name", "brand", "price_chf", "regular_price_chf", "discount_pct", "valid_from", "valid_to"
    )
    return top(df, _by_discount(), limit)


def active(promotions: DataFrame, as_of: date) -> DataFrame:
    """Promotions running on the given day (both bounds inclusive)."""
    return promotions.filter(F.lit(as_of).between(F.col("valid_from"), F.col("valid_to")))


def best_offers(promotions: DataFrame, mapping: DataFrame, as_of: date) -> DataFrame:
    """Cheapest running promotion per ingredient."""
    links = mapping.select(F.col("promotion_id").alias("id"), "ingredient_id")
    offers = active(promotions, as_of).select("id", "retailer_id", "price_chf", "discount_pct")
    return (
        offers.join(links, "id")
        .groupBy("ingredient_id")
        .agg(
            F.min(F.struct("price_chf", "id", "retailer_id", "discount_pct")).alias("best"),
            F.count(F.lit(1)).alias("n_offers"),
        )
        .select(
            "ingredient_id",
            F.col("best.id").alias("promotion_id"),
            "best.retailer_id",
            "best.price_chf",
            "best.discount_pct",
            "n_offers",
        )
    )


def suggest_for_promotions(
    recipes: DataFrame, recipe_ingredients: DataFrame, offers: DataFrame, limit: int | None = 5
) -> DataFrame:
    """Active recipes by the summed discount of their ingredients on offer."""
    lines = recipe_ingredients.select("recipe_id", "ingredient_id")
    value = (
        join_dimension(lines, offers.select("ingredient_id", "discount_pct"), "ingredient_id")
        .groupBy("recipe_id")
        .agg(F.count(F.lit(1)).alias("n_on_offer"), F.round(F.sum("discount_pct"), 3).alias("value"))
    )
    active_ = recipes.filter("status = 'active'").select(F.col("id").alias("recipe_id"), "title")
    return top(value.join(active_, "recipe_id"), [F.col("value").desc(), F.col("recipe_id")], limit)
