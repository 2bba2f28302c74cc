"""Recipes in the structured data of pages (JSON-LD), read with Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import non_empty, strip

_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
_EMPTY = "array<string>"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_list(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("ARRAY"))


def _is_text(value: Column) -> Column:
    return _kind(value) == "STRING"


def _is_object(value: Column) -> Column:
    return F.startswith(_kind(value), F.lit("OBJECT"))


def _text(value: Column) -> Column:
    return _get(value, "$", "string")


def _items(value: Column) -> Column:
    return F.coalesce(_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _none() -> Column:
    return F.array().cast(_EMPTY)


def extract_recipes(pages: DataFrame, html: str = "html", *, accept_type_lists: bool = False) -> DataFrame:
    """One row per ``Recipe`` object of a page, as the variant column ``recipe``.

    Objects may stand alone, in a list, or one level down in ``@graph``. Pages with no or broken
    structured data give no rows. The type must be the text ``Recipe``; with ``accept_type_lists``
    a list containing it counts as well.
    """
    keep = [c for c in pages.columns if c != html]
    path = "$['@type']"

    def is_recipe(node: Column) -> Column:
        single = F.coalesce(_get(node, path, "string") == "Recipe", F.lit(False))
        if not accept_type_lists:
            return single
        return single | F.coalesce(F.array_contains(_get(node, path, "array<string>"), "Recipe"), F.lit(False))

    documents = (
        pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(_SCRIPT), 1)).alias("_script", "_json"))
        .withColumn("_doc", F.try_parse_json("_json"))
        .filter("_doc is not null")
    )
    whole = F.when(_is_list(F.col("_doc")), _items(F.col("_doc"))).otherwise(F.array("_doc"))
    top = documents.select(*keep, "_script", F.posexplode(whole).alias("_item", "_node"))
    nested = F.when(is_recipe(F.col("_node")), F.array("_node")).otherwise(
        F.coalesce(_get(F.col("_node"), "$['@graph']", "array<variant>"), F.array().cast("array<variant>"))
    )
    return (
        top.select(*keep, "_script", "_item", F.posexplode(nested).alias("_sub", "recipe"))
        .filter(is_recipe(F.col("recipe")))
        .select(*keep, F.struct("_script", "_item", "_sub").alias("place"), "recipe")
    )


def text_lines(value: Column) -> Column:
    """Lines of a text, or the elements of a list, trimmed and without empty ones."""
    return (
        F.when(_is_text(value), non_empty(F.split(_text(value), "\n")))
        .when(_is_list(value), non_empty(F.transform(_items(value), _text)))
        .otherwise(_none())
    )


def instructions(value: Column) -> Column:
    """Steps from texts, ``HowToStep`` objects and ``HowToSection`` objects nested to any depth, in order."""
    kind = lambda node: _get(node, "$['@type']", "string")

    def inside(section: Column) -> Column:
        inner = _get(section, "$.itemListElement", "variant")
        lines = F.transform(non_empty(F.split(_text(inner), "\n")), lambda x: x.cast("variant"))
        return F.when(_is_list(inner), _items(inner)).when(_is_text(inner), lines).otherwise(_items(F.lit(None).cast("variant")))

    def opened(nodes: Column, _level: Column) -> Column:
        """Every section replaced by what it holds."""
        one = lambda n: F.when(F.coalesce(kind(n) == "HowToSection", F.lit(False)), inside(n)).otherwise(F.array(n))
        return F.flatten(F.transform(nodes, one))

    # Sections cannot be nested deeper than there are lists of elements in the text.
    levels = F.size(F.split(F.to_json(value), '"itemListElement"')) - 1
    nodes = F.when(levels > 0, F.aggregate(F.sequence(F.lit(1), levels), _items(value), opened)).otherwise(_items(value))

    def step(node: Column) -> Column:
        said = F.when(_is_text(node), _text(node)).when(
            kind(node) == "HowToStep", F.coalesce(_get(node, "$.text", "string"), F.lit(""))
        )
        return strip(said)

    listed = F.filter(F.transform(nodes, step), lambda x: x.isNotNull() & (x != ""))
    return (
        F.when(_is_text(value), non_empty(F.split(_text(value), "\n"))).when(_is_list(value), listed).otherwise(_none())
    )


def first_text(value: Column) -> Column:
    """A text, or the first element of a list, trimmed; empty when there is none."""
    head = _text(F.get(_items(value), 0))
    return F.coalesce(strip(F.when(_is_list(value), head).when(_is_text(value), _text(value))), F.lit(""))


def yield_text(value: Column) -> Column:
    """Yield as text from a text, a number or a list."""
    head = _text(F.get(_items(value), 0))
    return F.coalesce(strip(F.when(_is_list(value), head).otherwise(_text(value))), F.lit(""))


def keyword_list(value: Column) -> Column:
    """Keywords from a comma-separated text or a list."""
    return (
        F.when(_is_text(value), non_empty(F.split(_text(value), ",")))
        .when(_is_list(value), non_empty(F.transform(_items(value), _text)))
        .otherwise(_none())
    )


def images(value: Column) -> Column:
    """``array<struct<url, caption>>`` from a text, an image object or a list of both."""

    def one(node: Column) -> Column:
        caption = strip(
            F.coalesce(
                F.nullif(_get(node, "$.caption", "string"), F.lit("")), _get(node, "$.name", "string"), F.lit("")
            )
        )
        return F.when(
            _is_text(node), F.struct(_text(node).alias("url"), F.lit("").alias("caption"))
        ).when(_is_object(node), F.struct(_get(node, "$.url", "string").alias("url"), caption.alias("caption")))

    nodes = F.when(_is_list(value), _items(value)).when(value.isNotNull(), F.array(value)).otherwise(
        F.array().cast("array<variant>")
    )
    return F.filter(F.transform(nodes, one), lambda x: x.isNotNull() & x["url"].isNotNull() & (x["url"] != ""))


def to_raw_records(recipes: DataFrame, url: str = "url", language: str = "language") -> DataFrame:
    """Raw records of extracted objects; ``error`` is set where the required name is missing."""

    def part(name: str) -> Column:
        return F.col(f"_{name}")

    def text(name: str) -> Column:
        return F.coalesce(_get(F.col("recipe"), f"$.{name}", "string"), F.lit(""))

    keep = [c for c in recipes.columns if c not in ("recipe", language)]
    nodes = recipes.select(
        *keep,
        language,
        "recipe",
        *[
            _get(F.col("recipe"), f"$.{name}", "variant").alias(f"_{name}")
            for name in (
                "recipeIngredient", "recipeInstructions", "recipeYield", "image", "keywords", "recipeCategory",
                "recipeCuisine",
            )
        ],
    ).withColumn("_images", images(F.col("_image")))
    title = strip(text("name"))
    return nodes.select(
        *keep,
        title.alias("title"),
        strip(text("description")).alias("description"),
        text_lines(part("recipeIngredient")).alias("ingredients_raw"),
        F.array().cast("array<struct<label:string,items:array<string>>>").alias("ingredient_groups"),
        instructions(part("recipeInstructions")).alias("steps_raw"),
        yield_text(part("recipeYield")).alias("yield_amount"),
        text("prepTime").alias("prep_time"),
        text("cookTime").alias("cook_time"),
        text("totalTime").alias("total_time"),
        F.transform("_images", lambda x: x["url"]).alias("image_urls"),
        F.transform("_images", lambda x: x["caption"]).alias("image_captions"),
        keyword_list(part("keywords")).alias("keywords"),
        F.col(url).alias("source_url"),
        F.col(language),
        first_text(part("recipeCategory")).alias("category"),
        first_text(part("recipeCuisine")).alias("cuisine"),
        F.lit("").alias("difficulty"),
        F.when(title == "", "missing name").alias("error"),
    )
