"""URL-derived columns: ids, slugs, image keys, CDN variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name formats and the resizable image host.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif"]
DEFAULT_EXTENSION = ".jpg"
RESIZABLE_HOST = "recipeimages.migros.ch"
RESIZABLE_SEGMENT = r"v-w-(\d+)-h-(\d+)"


def url_path(url: Column) -> Column:
    """Path part of a URL, without parameters, query and fragment."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def slug_words(url: Column) -> Column:
    """Last path segment with hyphens turned into blanks."""
    path = F.regexp_replace(url_path(url), "/+$", "")
    return F.replace(F.element_at(F.split(path, "/"), -1), F.lit("-"), F.lit(" "))


def external_id(url: Column, language: Column) -> Column:
    """Last non-empty URL segment without extension, plus ``-{language}`` when it is not there yet."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    last = F.get(F.filter(F.reverse(F.split(bare, "/")), lambda x: x != ""), 0)
    slug = F.regexp_replace(last, r"(?i)\.(html?|php|aspx?)$", "")
    suffix = F.concat(F.lit("-"), language)
    add = language.isNotNull() & (language != "") & ~F.endswith(slug, suffix)
    return F.coalesce(F.when(add, F.concat(slug, suffix)).otherwise(slug), F.lit(""))


def first_srcset_url(srcset: Column) -> Column:
    """First URL of a ``srcset`` attribute."""
    return F.trim(F.split(F.split(srcset, ",")[0], " ")[0])


def absolute_url(src: Column, base: str) -> Column:
    """Complete a root-relative address with its site."""
    return F.when(F.startswith(src, F.lit("/")), F.concat(F.lit(base), src)).otherwise(src)


def image_extension(url: Column) -> Column:
    """Known image extension of a URL, else ``.jpg``."""
    path = F.split(url_path(url), "/-")[0]
    extension = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return F.when(extension.isin(IMAGE_EXTENSIONS), extension).otherwise(DEFAULT_EXTENSION)


def image_key(recipe_id: Column, seq: Column, url: Column, extension: Column | None = None) -> Column:
    """Deterministic image file name ``{recipe}_{seq:03d}_{hash}{ext}``."""
    digest = F.substring(F.sha2(url, 256), 1, 12)
    return F.format_string(
        "%d_%03d_%s%s",
        recipe_id.cast("bigint"),
        seq.cast("int"),
        digest,
        image_extension(url) if extension is None else extension,
    )


def resized_url(url: Column, max_width: int) -> Column:
    """Ask a resizing image host for at most ``max_width`` pixels, keeping the aspect ratio."""
    width = F.regexp_extract(url, RESIZABLE_SEGMENT, 1).try_cast("bigint")
    height = F.regexp_extract(url, RESIZABLE_SEGMENT, 2).try_cast("bigint")
    scaled = F.floor(height * (F.lit(float(max_width)) / width)).cast("bigint")
    segment = F.concat(F.lit(f"v-w-{max_width}-h-"), scaled.cast("string"))
    old = F.regexp_extract(url, RESIZABLE_SEGMENT, 0)
    at = F.instr(url, old)
    rewritten = F.concat(F.substr(url, F.lit(1), at - 1), segment, F.substr(url, at + F.length(old)))
    shrink = url.contains(RESIZABLE_HOST) & (width > max_width)
    return F.when(shrink, rewritten).otherwise(url)
