"""Sitemap and URL rules: which pages to load, and in which language."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.text import non_empty


class SourceRule(NamedTuple):
    id: int
    key: str
    display_name: str
    base_url: str
    url_pattern: str
    languages: tuple[tuple[str, str], ...]
    default_language: str = "de"


# The known page sources, their recipe-URL patterns and language markers.
SOURCES = [
    SourceRule(1, "bettybossi", "Betty Bossi", "https://www.bettybossi.ch",
               r"/de/rezepte/rezept/|/fr/recettes/recette/", (("/fr/", "fr"),)),
    SourceRule(2, "fooby", "Fooby", "https://fooby.ch",
               r"/rezepte/|/recettes/|/ricette/", (("/de/", "de"), ("/fr/", "fr"), ("/it/", "it"))),
    SourceRule(3, "migusto", "Migusto", "https://migusto.migros.ch",
               r"/rezepte/|/recettes/|/ricette/", (("/fr/", "fr"), ("/it/", "it"))),
    SourceRule(4, "swissmilk", "Swissmilk", "https://www.swissmilk.ch",
               r"/rezepte-kochideen/rezepte/|/recettes-idees-cuisine/recettes/", (("/fr/", "fr"),)),
    SourceRule(5, "schweizerfleisch", "Schweizer Fleisch", "https://www.schweizerfleisch.ch",
               r"(?U)^(?:https://schweizerfleisch\.ch/rezepte/[\w-]+|https://viandesuisse\.ch/recettes/[\w-]+)$",
               (("viandesuisse.ch", "fr"),)),
]


def source_rows(spark: SparkSession, sources: list[SourceRule] = SOURCES) -> DataFrame:
    """Rows for the ``sources`` table."""
    rows = [(s.id, s.key, s.display_name, s.base_url, s.default_language, "scraped") for s in sources]
    return spark.createDataFrame(
        rows, "id int, key string, display_name string, base_url string, language string, kind string"
    )


def enabled_sources(
    sources: list[SourceRule] = SOURCES, key: str | None = None, disabled: tuple[str, ...] = ()
) -> list[SourceRule]:
    """Rules of the enabled sources, or of one source."""
    return [s for s in sources if s.key not in disabled and (key is None or s.key == key)]


def _by_source(source: Column, choose) -> Column:
    result = None
    for rule in SOURCES:
        value = choose(rule)
        result = F.when(source == rule.key, value) if result is None else result.when(source == rule.key, value)
    return result


def is_recipe_url(url: Column, source: Column) -> Column:
    """Does the address look like a recipe page of its source?"""
    return F.coalesce(_by_source(source, lambda rule: url.rlike(rule.url_pattern)), F.lit(False))


def detect_language(url: Column, source: Column | None = None) -> Column:
    """Language marked in the address; the first marker of the source wins, else its default."""

    def choose(markers, default):
        result = None
        for marker, language in markers:
            hit = url.contains(marker)
            result = F.when(hit, language) if result is None else result.when(hit, language)
        return result.otherwise(default)

    generic = choose((("/de/", "de"), ("/fr/", "fr"), ("/it/", "it")), "de")
    if source is None:
        return generic
    return F.coalesce(_by_source(source, lambda rule: choose(rule.languages, rule.default_language)), generic)


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per address of a sitemap: page addresses, or those of nested sitemaps in an index."""
    pages = non_empty(F.xpath(F.col(xml), F.lit("//url/loc/text()")))
    nested = non_empty(F.xpath(F.col(xml), F.lit("//sitemap/loc/text()")))
    keep = [c for c in sitemaps.columns if c != xml]
    return sitemaps.select(*keep, F.posexplode(F.when(F.size(pages) > 0, pages).otherwise(nested)).alias("position", "url"))


def discover(sitemaps: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Recipe addresses of ``sitemaps(source, xml)``, optionally only in the given languages."""
    found = sitemap_urls(sitemaps).filter(is_recipe_url(F.col("url"), F.col("source")))
    found = found.withColumn("language", detect_language(F.col("url"), F.col("source")))
    return found.filter(F.col("language").isin(languages)) if languages else found
