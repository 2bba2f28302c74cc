"""Tags and recipe-tag links from keywords, classification columns and user assignments."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.text import mapped, strip, tag_slug
from larder.operators.changes import max_id
from larder.plans.joins import dense_ids, join_dimension


class TagRows(NamedTuple):
    tags: DataFrame
    links: DataFrame


def _assign(mentions: DataFrame, existing: DataFrame) -> TagRows:
    """New tags and links from ``mentions(recipe_id, pos, key, display, facet)``.

    A tag takes display and facet from its first mention; ids continue after the existing ones in
    the order of first mention. First mentions are found by a map-side combined aggregate.
    """
    first = mentions.groupBy("key").agg(
        F.min(F.struct("recipe_id", "pos", "display", "facet")).alias("first")
    )
    fresh = first.join(existing.select("key").distinct(), "key", "left_anti").select(
        "key", "first.display", "first.facet", F.col("first.recipe_id").alias("_r"), F.col("first.pos").alias("_p")
    )
    new_tags = dense_ids(fresh, [F.col("_r"), F.col("_p"), F.col("key")], max_id(existing) + 1).select(
        "id", "key", "display", "facet"
    )
    ids = existing.select("key", F.col("id").cast("bigint").alias("tag_id")).unionByName(
        new_tags.select("key", F.col("id").alias("tag_id"))
    )
    links = join_dimension(mentions.select("recipe_id", "key"), ids, "key").select("recipe_id", "tag_id")
    return TagRows(new_tags, links)


def keyword_mentions(records: DataFrame, recipe: str = "recipe_id", keywords: str = "keywords") -> DataFrame:
    """Usable keywords of each recipe: slugged, noise dropped, mapped to canonical keys, with facet."""
    word = F.col("word")
    slug = F.col("slug")
    canonical = mapped(slug, V.CANONICAL_TAGS)
    return (
        records.select(F.col(recipe).alias("recipe_id"), F.posexplode(keywords).alias("pos", "word"))
        .withColumn("slug", tag_slug(word))
        .filter((slug != "") & ~slug.isin(V.BLOCKED_TAGS))
        .select(
            "recipe_id",
            "pos",
            F.coalesce(canonical, slug).alias("key"),
            F.coalesce(canonical, strip(word)).alias("display"),
            F.coalesce(mapped(F.lower(strip(word)), V.FACETS), F.lit(V.DEFAULT_FACET)).alias("facet"),
        )
    )


def keyword_tags(records: DataFrame, existing: DataFrame) -> TagRows:
    """Tags and links from ``records(recipe_id, keywords)``."""
    return _assign(keyword_mentions(records), existing)


def classification_mentions(recipes: DataFrame) -> DataFrame:
    """Diet, course, difficulty and method of each recipe as tag mentions."""

    def named(value: Column, facet: str) -> Column:
        return F.struct(value.alias("display"), F.lit(facet).alias("facet"))

    diet = F.transform(
        F.coalesce("dietary_flags", F.array().cast("array<string>")), lambda f: named(f, "dietary")
    )
    single = F.array(
        named(F.col("course"), "course"),
        named(F.col("difficulty"), "difficulty"),
        named(F.col("cooking_method"), "method"),
    )
    return (
        recipes.select(F.col("id").alias("recipe_id"), F.posexplode(F.concat(diet, single)).alias("pos", "x"))
        .select("recipe_id", "pos", tag_slug(F.col("x.display")).alias("key"), "x.display", "x.facet")
        .filter("key is not null and key != ''")
    )


def classification_tags(recipes: DataFrame, existing: DataFrame) -> TagRows:
    """Tags and links from the classification columns."""
    return _assign(classification_mentions(recipes), existing)


def user_tags(
    assignments: DataFrame, recipes: DataFrame, existing: DataFrame, recipe_tags: DataFrame
) -> TagRows:
    """Tags and absent links for ``assignments(recipe_id, tag)`` of known recipes."""
    known = recipes.select(F.col("id").alias("recipe_id"))
    slugged = (
        assignments.select("recipe_id", tag_slug(F.col("tag")).alias("key")).filter("key != ''").distinct()
    )
    mentions = slugged.join(known, "recipe_id", "left_semi").select(
        "recipe_id",
        F.lit(0).alias("pos"),
        "key",
        F.replace("key", F.lit("-"), F.lit(" ")).alias("display"),
        F.lit(V.USER_FACET).alias("facet"),
    )
    rows = _assign(mentions, existing)
    links = rows.links.dropDuplicates(["recipe_id", "tag_id"]).join(
        recipe_tags.select("recipe_id", "tag_id").distinct(), ["recipe_id", "tag_id"], "left_anti"
    )
    return TagRows(rows.tags, links)
