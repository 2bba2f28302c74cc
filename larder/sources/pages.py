"""Recipe fields from page markup, and the preference of structured data over markup.

Everything is a native column expression over ``pages(url, html)``; the rules below say where a
field may stand, so that a new page source is a new rule and not new code. A page is cut into tokens once (:class:`Page`), from which all
selectors read; they take the markup alone as well.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import name2codepoint
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import any_of, empty_to_null, first_mapped, let, non_empty, split_keywords, squeeze, strip
from larder.functions.urls import absolute_url, first_srcset_url

# Markup names, skip lists and value lists of the known page sources.
GENERIC_BREADCRUMBS = [
    "Home", "Accueil", "Fooby", "Migusto", "Rezepte", "Recettes", "Ricette", "Rezepte & Kochideen",
    "Recettes & idées cuisine",
]
INGREDIENT_HEADINGS = ["zutaten", "ingrédients", "ingredients", "ingredienti"]
NAVIGATION_WORDS = [
    "hauptmenü", "menu schliessen", "jetzt entdecken", "jetzt weiterstöbern", "werbung buchen", "shop",
]
MAX_LINE_LENGTH = 200
# Fixed value: hosts whose ingredient lists take in navigation; the two rules above hold for their pages only.
NAVIGATION_HOSTS = ["bettybossi.ch"]
EQUIPMENT_WORDS = [
    "schnur", "grillholz", "holzbrettchen", "alu-grill", "grillschalen", "spiesschen", "spiess",
    "backpapier", "alufolie", "frischhaltefolie", "zahnstocher",
]
BRAND_PREFIXES = ["Fine Food ", "Naturaplan ", "Prix Garantie ", "Betty Bossi "]
UNIT_MARKS = ["g ", "kg ", "dl ", "l ", "EL ", "TL ", "Stk", "Prise"]
DIFFICULTY_WORDS = [
    "einfach", "easy", "leicht", "simpel", "mittel", "medium", "modéré", "schwer", "advanced",
    "difficile", "anspruchsvoll", "facile", "moyen",
]
PAGE_CUISINES: dict[str, str] = {
    "italian": "italian", "italienisch": "italian", "italienische küche": "italian", "swiss": "swiss",
    "schweizer": "swiss", "schweizer küche": "swiss", "asian": "asian", "asiatisch": "asian",
    "asiatische küche": "asian", "mexican": "mexican", "mexikanisch": "mexican", "indian": "indian",
    "indisch": "indian", "french": "french", "französisch": "french", "thai": "thai",
    "japanese": "japanese", "japanisch": "japanese", "greek": "greek", "griechisch": "greek",
    "orientalisch": "middle-eastern", "mediterran": "mediterranean", "mediterranean": "mediterranean",
    "mediterrane küche": "mediterranean", "chinese": "chinese", "chinesisch": "chinese",
    "korean": "korean", "koreanisch": "korean", "vietnamese": "vietnamese",
    "vietnamesisch": "vietnamese", "spanish": "spanish", "spanisch": "spanish",
}
_BODY = r"(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_REFERENCE, _LEADING_REFERENCE, _OTHER_REFERENCE = rf"&{_BODY}", rf"^{_BODY}", rf"&(?!amp;){_BODY}"
#: Named references of HTML, as the standard library lists them; a hard space becomes a plain one.
_NAMED = {name: chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}


def _decoded(name: Column) -> Column:
    """The character of a reference, given without ``&`` and ``;``; null when there is none of that name."""
    named = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")  # folded to one literal
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    digits = F.when(hexadecimal, F.substr(name, F.lit(3))).otherwise(F.substr(name, F.lit(2)))
    number = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits)

    def character(point: Column) -> Column:
        valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        wide = F.unhex(F.lpad(F.hex(F.when(valid, point).otherwise(F.lit(0xFFFD))), 8, "0"))
        return F.when(point == 160, " ").otherwise(F.decode(wide, "UTF-32"))

    return F.when(F.startswith(name, F.lit("#")), let(number.try_cast("int"), character)).otherwise(F.element_at(named, name))


def unescape(text: Column) -> Column:
    """Replace numeric and named character references, each once; what is none stays as it is.

    Each distinct reference of a text is looked up once and replaced throughout. Only those for letters, digits, ``#``, ``;`` and ``&``, which
    could form a further reference with what surrounds them, are replaced one by one; of these ``&amp;``, where it is the only one, comes last.
    """

    def replaced(acc: Column, reference: Column) -> Column:
        char = _decoded(F.btrim(reference, F.lit("&;")))
        return let(char, lambda c: F.when(F.rlike(c, F.lit(r"^[^A-Za-z0-9#;&]")), F.replace(acc, reference, c)).otherwise(acc))

    def plain(raw: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(raw, F.lit(_REFERENCE), 0))
        return F.aggregate(found, raw, lambda acc, r: F.coalesce(replaced(acc, r), acc))

    def decoded(part: Column) -> Column:
        def known(name: Column) -> Column:
            char = F.when(name != "", _decoded(F.rtrim(name, F.lit(";"))))
            return let(char, lambda c: F.coalesce(F.concat(c, F.substr(part, F.length(name) + 1)), F.concat(F.lit("&"), part)))

        return let(F.regexp_extract(part, _LEADING_REFERENCE, 0), known)

    def joined(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded)
        return F.concat(F.get(parts, 0), F.array_join(rest, ""))

    def rest(t: Column) -> Column:
        one_by_one = let(F.split(t, "&"), joined)
        return F.when(F.rlike(t, F.lit(_OTHER_REFERENCE)), one_by_one).otherwise(F.replace(t, F.lit("&amp;"), F.lit("&")))

    return let(text, lambda raw: F.when(raw.contains("&"), let(plain(raw), rest)).otherwise(raw))


def inner_text(markup: Column) -> Column:
    """Text of a markup fragment, single-spaced."""
    return squeeze(unescape(F.regexp_replace(markup, r"(?s)<!--.*?-->|<[^>]*>", "")))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return unescape(F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)))


def _tags(page: Column | Page, pattern: str) -> Column:
    return F.regexp_extract_all(_html(page), F.lit(pattern), 0)


def _opening(names: Sequence[str], tag: str = r"[a-z0-9]+") -> str:
    """Opening tag that carries one of the classes."""
    return rf"(?is)<(?:{tag})\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*[\s])?(?:{any_of(names)})(?:[\s][^\"']*)?[\"'][^>]*>"


_MARKUP = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)>|<[^>]*>|[^<]+|<"
# Elements without an end tag.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


class Page(NamedTuple):
    """Markup of a page and the column of its :func:`page_tags`."""

    html: Column
    tags: Column


def _html(page: Column | Page) -> Column:
    return page.html if isinstance(page, Page) else page


def page_tags(html: Column) -> Column:
    """``struct<tokens, tags>``: the markup cut at its tags, and of those tags that open (``step`` 1) or end (-1) an element the place among the tokens
    and the name. Comments, scripts, styles and elements that have no end tag open nothing.
    """

    def tag(token: Column, at: Column) -> Column:
        def opens(name: Column) -> Column:
            script = name.isin("script", "style") & F.rlike(token, F.lit(r"(?is)^<(?:script|style)\b.*</"))
            alone = F.endswith(token, F.lit("/>")) | name.isin(VOID_ELEMENTS) | script
            step = F.when((name == "") | alone, 0).when(F.startswith(token, F.lit("</")), -1).otherwise(1)
            return F.struct((at + 1).alias("at"), name.alias("name"), step.alias("step"))

        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        return F.when(F.startswith(token, F.lit("<")), let(name, opens))

    def read(tokens: Column) -> Column:
        return F.struct(tokens.alias("tokens"), F.filter(F.transform(tokens, tag), lambda t: t["step"] != 0).alias("tags"))

    return let(F.regexp_extract_all(html, F.lit(_MARKUP), 0), read)


def elements(page: Column | Page, opening: str) -> Column:
    """Markup of the outermost elements whose opening tag matches, each up to its own end tag.

    Elements of the same name inside are counted, so the first end tag need not be the right one. An element without end
    tag lasts to the end of the page.
    """

    def state(name: Column, depth: Column, start: Column, found: Column) -> Column:
        return F.struct(name.alias("name"), depth.alias("depth"), start.alias("start"), found.alias("found"))

    def read(cut: Column) -> Column:
        tokens, tags = cut["tokens"], cut["tags"]
        zero = state(F.lit(""), F.lit(0), F.lit(0), F.array().cast("array<struct<start:int,size:int>>"))

        def add(acc: Column, tag: Column) -> Column:
            hit = (tag["step"] == 1) & F.rlike(F.get(tokens, tag["at"] - 1), F.lit(opening))
            opened = state(tag["name"], F.lit(1), tag["at"], acc["found"])
            depth = acc["depth"] + tag["step"]
            whole = F.struct(acc["start"].alias("start"), (tag["at"] - acc["start"] + 1).alias("size"))
            closed = state(F.lit(""), F.lit(0), F.lit(0), F.array_append(acc["found"], whole))
            within = F.when(depth == 0, closed).otherwise(state(acc["name"], depth, acc["start"], acc["found"]))
            inside = F.when(tag["name"] == acc["name"], within).otherwise(acc)
            return F.when(acc["depth"] > 0, inside).when(hit, opened).otherwise(acc)

        def finish(acc: Column) -> Column:
            rest = F.struct(acc["start"].alias("start"), (F.size(tokens) - acc["start"] + 1).alias("size"))
            return F.when(acc["depth"] > 0, F.array_append(acc["found"], rest)).otherwise(acc["found"])

        places = F.aggregate(tags, zero, add, finish)
        return F.transform(places, lambda r: F.array_join(F.slice(tokens, r["start"], r["size"]), ""))

    html = _html(page)
    found = read(page.tags) if isinstance(page, Page) else let(page_tags(html), read)
    return F.when(F.rlike(html, F.lit(opening)), found).otherwise(F.array().cast("array<string>"))


def title(html: Column) -> Column:
    """Text of the first ``h1``."""
    return inner_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))


def meta(page: Column | Page, key: str) -> Column:
    """Content of the first ``meta`` tag with the given name or property; empty when absent."""
    tag = F.regexp_extract(_html(page), rf"(?is)<meta\b[^>]*\b(?:name|property)\s*=\s*[\"']{key}[\"'][^>]*>", 0)
    return strip(_attribute(tag, "content"))


def meta_keywords(html: Column | Page) -> Column:
    return split_keywords(meta(html, "keywords"))


def _links_in(html: Column | Page, classes: Sequence[str]) -> Column:
    blocks = F.array_join(elements(html, _opening(classes, "nav|ul|ol|div|li|p|span")), " ")
    return non_empty(F.transform(_tags(blocks, r"(?is)<a\b[^>]*>.*?</a>"), inner_text))


def breadcrumbs(html: Column | Page) -> Column:
    """Distinct breadcrumb texts without the generic ones."""
    found = _links_in(html, ["breadcrumb", "breadcrumbs", "breadcrumb-item", "Breadcrumb"])
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(GENERIC_BREADCRUMBS)))


def category(html: Column | Page) -> Column:
    """Section meta tag, category link, else first specific breadcrumb."""
    link = F.regexp_extract(_html(html), r"(?is)<a\b[^>]*href\s*=\s*[\"'][^\"']*/(?:kategorie|catégorie)/[^>]*>(.*?)</a>", 1)
    return F.coalesce(
        empty_to_null(meta(html, "article:section")),
        empty_to_null(inner_text(link)),
        F.get(breadcrumbs(html), 0),
        F.lit(""),
    )


def tag_links(html: Column | Page) -> Column:
    """Texts of the links in tag lists and of keyword links."""
    keyed = F.transform(
        _tags(html, r"(?is)<a\b[^>]*href\s*=\s*[\"'][^\"']*/schlagwort/[^>]*>.*?</a>"), inner_text
    )
    return F.array_distinct(F.concat(_links_in(html, ["recipe-tags", "RecipeTags", "tag"]), non_empty(keyed)))


def keywords(html: Column | Page, links: Column | None = None) -> Column:
    """Keywords of the meta tag, else tag links (``links``, where they are known)."""
    from_meta = meta_keywords(html)
    return F.when(F.size(from_meta) > 0, from_meta).otherwise(tag_links(html) if links is None else links)


def cuisine(html: Column | Page, links: Column | None = None) -> Column:
    """First known cuisine among tag links, then meta keywords; empty when there is none."""
    lowered = F.transform(F.concat(tag_links(html) if links is None else links, meta_keywords(html)), F.lower)
    return F.coalesce(first_mapped(lowered, PAGE_CUISINES), F.lit(""))


def difficulty(html: Column | Page, links: Column | None = None) -> Column:
    """First difficulty word among tag links and the info boxes of a page; empty when there is none."""
    boxes = F.array_join(elements(html, _opening(["RecipeFacts", "recipe-meta", "recipe-info"], "div|ul|section")), " ")
    spans = F.transform(_tags(boxes, r"(?is)<(span|div|li)\b[^>]*>[^<]*</\1>"), inner_text)
    own = F.transform(elements(html, _opening(["recipe-difficulty"])), inner_text)
    found = F.filter(F.concat(tag_links(html) if links is None else links, spans, own), lambda x: F.lower(x).isin(DIFFICULTY_WORDS))
    return F.coalesce(F.get(found, 0), F.lit(""))


def item_property(html: Column, name: str) -> Column:
    """``content`` of the first element with an ``itemprop``, else its text."""

    def value(whole: Column) -> Column:
        content = strip(_attribute(F.regexp_extract(whole, r"(?s)^<[^>]*>", 0), "content"))
        return F.coalesce(empty_to_null(content), inner_text(whole), F.lit(""))

    return let(F.regexp_extract(html, rf"(?is)<([a-z0-9]+)\b[^>]*\bitemprop\s*=\s*[\"']{name}[\"'][^>]*>(?:.*?</\1>)?", 0), value)


def mixes_navigation(url: Column) -> Column:
    """Whether a page comes from a source whose lists of ingredients take in navigation."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))
    return F.coalesce(host.rlike(rf"(?:^|\.)(?:{any_of(NAVIGATION_HOSTS)})$"), F.lit(False))


def _is_line(text: Column, navigation: Column) -> Column:
    plain = (F.length(text) <= MAX_LINE_LENGTH) & ~F.lower(text).rlike(any_of(NAVIGATION_WORDS))
    return (text != "") & (~navigation | plain)


def valid_lines(lines: Column, navigation: Column | None = None) -> Column:
    """Drop empty texts and, where ``navigation`` holds (:func:`mixes_navigation`), overlong and navigation texts."""
    return F.filter(lines, lambda x: _is_line(x, F.lit(False) if navigation is None else navigation))


def _items(html: Column | Page, opening: str) -> Column:
    """Markup of list items whose opening tag matches; an item that holds a list goes up to its own end tag."""
    short = _tags(html, rf"{opening}.*?</li>")
    nested = F.exists(short, lambda m: m.rlike(r"(?is)^<li\b[^>]*>.*<li\b"))
    return F.when(nested, elements(html, opening)).otherwise(short)


def list_items(html: Column | Page) -> Column:
    """Texts of all list items; the text of an item takes in the lists inside it."""
    return F.transform(_items(html, r"(?is)<li\b[^>]*>"), inner_text)


def ingredient_lines(html: Column | Page, navigation: Column | None = None) -> Column:
    """Marked ingredient items, ingredient table rows, else list items that name a unit."""
    marked = _items(html, r"(?is)<li\b[^>]*\bitemprop\s*=\s*[\"']recipeIngredient[\"'][^>]*>")
    classed = elements(html, _opening(["ingredient-item", "ingredient", "Ingredient"], "li|div|tr|p"))
    measured = F.filter(list_items(html), lambda x: x.rlike(any_of(UNIT_MARKS)))
    clean = lambda found: valid_lines(F.transform(found, lambda m: inner_text(F.regexp_replace(m, "<", " <"))), navigation)
    first, second = clean(marked), clean(classed)
    return (
        F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(valid_lines(measured, navigation))
    )


def ingredient_groups(html: Column | Page, navigation: Column | None = None) -> Column:
    """Groups ``array<struct<label, items>>`` of headed lists in all ingredient sections, in page order."""
    sections = elements(
        html,
        r"(?is)<(?:section|div)\b[^>]*\bclass\s*=\s*[\"'][^\"']*(?:ingredients|ingredient-section|ingredient-group"
        r"|ingredientGroup)[^\"']*[\"'][^>]*>",
    )
    return F.flatten(F.transform(sections, lambda section: _section_groups(section, F.lit(False) if navigation is None else navigation)))


def _section_groups(section: Column, navigation: Column) -> Column:
    parts = F.transform(
        _tags(section, r"(?is)<(h[345]|li)\b[^>]*>.*?</\1>"),
        lambda m: F.struct(m.rlike(r"(?i)^<h").alias("head"), inner_text(m).alias("text")),
    )
    parts = F.filter(
        parts,
        lambda p: F.when(p["head"], (p["text"] != "") & ~F.lower(p["text"]).isin(INGREDIENT_HEADINGS)).otherwise(
            _is_line(p["text"], navigation)
        ),
    )
    start = F.array(
        F.struct(F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("items"))
    )

    def add(groups: Column, part: Column) -> Column:
        last = F.element_at(groups, -1)
        longer = F.concat(
            F.slice(groups, 1, F.size(groups) - 1),
            F.array(F.struct(last["label"].alias("label"), F.array_append(last["items"], part["text"]).alias("items"))),
        )
        opened = F.array_append(
            groups, F.struct(part["text"].alias("label"), F.array().cast("array<string>").alias("items"))
        )
        return F.when(part["head"], opened).otherwise(longer)

    return F.filter(F.aggregate(parts, start, add), lambda g: F.size(g["items"]) > 0)


def steps(html: Column | Page) -> Column:
    """Preparation steps without leading numbers and repetitions."""
    marked = elements(html, r"(?is)<[a-z0-9]+\b[^>]*\bitemprop\s*=\s*[\"']text[\"'][^>]*>")
    classed = elements(
        html, _opening(["preparation__step", "PreparationList--step", "preparation-step", "recipe-step", "step"])
    )
    found = F.when(F.size(marked) > 0, marked).otherwise(classed)
    plain = F.transform(found, lambda m: strip(F.regexp_replace(inner_text(m), r"^\d+\s*", "")))
    return F.array_distinct(non_empty(plain))


def labelled_time(html: Column, label: str) -> Column:
    """Duration text behind a label such as ``Gesamtzeit``; empty when absent."""
    text = F.regexp_extract(html, rf"(?is)<(?:span|div|p)\b[^>]*>[^<]*{label}[^<]*<", 0)
    return strip(F.regexp_extract(text, r"(\d+\s*(?:h|min|Std)[\s\d]*(?:min)?)", 1))


def image_urls(html: Column | Page, base: str = "") -> Column:
    """Main image, then gallery images (lazy source, first of a source set, plain source)."""
    gallery = F.array_join(
        elements(
            html,
            _opening(
                ["recipe-gallery", "recipe-slider", "recipe-carousel", "recipe-images", "RecipeGallery", "RecipeSlider"],
                "div|section|ul",
            ),
        ),
        " ",
    )

    def source(tag: Column) -> Column:
        src = F.coalesce(
            empty_to_null(_attribute(tag, "data-src")),
            empty_to_null(first_srcset_url(_attribute(tag, "srcset"))),
            empty_to_null(_attribute(tag, "src")),
            F.lit(""),
        )
        return absolute_url(strip(src), base) if base else strip(src)

    pictures = F.filter(
        F.transform(_tags(gallery, r"(?is)<img\b[^>]*>"), source), lambda x: ~x.rlike(r"^data:|/_nuxt/|/icon|/sprites/")
    )
    return F.array_distinct(F.filter(F.concat(F.array(meta(html, "og:image")), pictures), lambda x: x != ""))


_PROPS = "struct<ingredientsLists:array<struct<entity:struct<title:string,name:string,ingredients:array<struct<entity:struct<amount:string,quantity:struct<entity:struct<shortForm:string,name:string>>,title:string>>>>>>,numberOfPersons:string>"  # noqa: E501


def component_props(html: Column) -> Column:
    """Parsed props of the first embedded component that carries ingredient lists or servings."""
    raw = F.regexp_extract_all(html, F.lit(r"(?is)data-react-props\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"), 0)
    props = F.transform(
        raw,
        lambda m: F.from_json(
            unescape(F.regexp_replace(m, r"(?is)^data-react-props\s*=\s*[\"']|[\"']\z", "")), _PROPS
        ),
    )
    useful = F.filter(
        props,
        lambda p: p.isNotNull() & (p["ingredientsLists"].isNotNull() | p["numberOfPersons"].isNotNull()),
    )
    return F.get(useful, 0)


def props_groups(props: Column) -> Column:
    """Ingredient groups of component props."""

    def line(item: Column) -> Column:
        entity = item["entity"]
        unit = entity["quantity"]["entity"]
        parts = F.array(
            empty_to_null(entity["amount"]),
            F.coalesce(empty_to_null(unit["shortForm"]), empty_to_null(unit["name"])),
            empty_to_null(entity["title"]),
        )
        return F.array_join(F.array_compact(parts), " ")

    def group(entry: Column) -> Column:
        entity = entry["entity"]
        label = empty_to_null(strip(F.coalesce(empty_to_null(entity["title"]), entity["name"])))
        items = F.filter(F.transform(entity["ingredients"], line), lambda x: x != "")
        return F.struct(label.alias("label"), F.coalesce(items, F.array().cast("array<string>")).alias("items"))

    groups = F.filter(F.transform(props["ingredientsLists"], group), lambda g: F.size(g["items"]) > 0)
    return F.coalesce(groups, F.array().cast("array<struct<label:string,items:array<string>>>"))


def from_markup(pages: DataFrame, language: str = "language", base: str = "") -> DataFrame:
    """Raw records from markup alone; ``error`` is set where a page has no title."""
    html, navigation = F.col("html"), F.col("_navigation")
    page, links = Page(html, F.col("_tags")), F.col("_links")
    staged = pages.withColumn("_navigation", mixes_navigation(F.col("url")))
    staged = staged.withColumn("_tags", page_tags(html)).withColumn("_links", tag_links(page))
    staged = staged.withColumn("_props", component_props(html)).withColumn("_groups", props_groups(F.col("_props")))
    staged = staged.withColumn(
        "_groups", F.when(F.size("_groups") > 0, F.col("_groups")).otherwise(ingredient_groups(page, navigation))
    )
    staged = staged.withColumn("_flat", F.flatten(F.transform("_groups", lambda g: g["items"])))
    staged = staged.withColumn("_flat", F.when(F.size("_flat") > 0, F.col("_flat")).otherwise(ingredient_lines(page, navigation)))
    staged = staged.withColumn("_title", title(html)).withColumn("_images", image_urls(page, base))
    persons = F.regexp_extract(html, r"(?s)>[^<]*?(\d+)\s*(?:Personen|Portionen)[^<]*<", 1)
    serves = F.coalesce(
        F.concat(F.col("_props.numberOfPersons"), F.lit(" Portionen")),
        empty_to_null(item_property(html, "recipeYield")),
        F.when(persons != "", F.concat(persons, F.lit(" Portionen"))),
        F.lit(""),
    )
    keep = [c for c in pages.columns if c not in ("html", language)]
    return staged.select(
        *keep,
        F.col("_title").alias("title"),
        meta(html, "description").alias("description"),
        F.col("_flat").alias("ingredients_raw"),
        F.col("_groups").alias("ingredient_groups"),
        steps(page).alias("steps_raw"),
        serves.alias("yield_amount"),
        F.coalesce(empty_to_null(item_property(html, "prepTime")), labelled_time(html, "Aktivzeit")).alias("prep_time"),
        F.coalesce(empty_to_null(item_property(html, "cookTime")), labelled_time(html, "Gesamtzeit")).alias("cook_time"),
        item_property(html, "totalTime").alias("total_time"),
        F.col("_images").alias("image_urls"),
        F.transform("_images", lambda _: F.col("_title")).alias("image_captions"),
        keywords(page, links).alias("keywords"),
        F.col("url").alias("source_url"),
        F.col(language),
        category(page).alias("category"),
        cuisine(page, links).alias("cuisine"),
        difficulty(page, links).alias("difficulty"),
        F.when(F.col("_title") == "", "no recipe title").alias("error"),
    )


def food_only(lines: Column) -> Column:
    """Strip brand prefixes and drop lines that name kitchen equipment."""
    unbranded = F.transform(lines, lambda x: F.regexp_replace(x, f"^(?:{any_of(BRAND_PREFIXES)})", ""))
    return F.filter(unbranded, lambda x: ~F.lower(x).rlike(any_of(EQUIPMENT_WORDS)))


def prefer(first: Column, second: Column) -> Column:
    """First text unless it is empty."""
    return F.coalesce(empty_to_null(first), second)


def prefer_list(first: Column, second: Column) -> Column:
    """First array unless it is empty."""
    return F.when(F.size(first) > 0, first).otherwise(second)


def complete_with_markup(records: DataFrame) -> DataFrame:
    """Fill keywords, category, cuisine, difficulty and captions of structured records from ``html``.

    Lines lose brand prefixes and equipment; labelled groups of the page replace the flat list.
    """
    page, links = Page(F.col("html"), F.col("_html_tags")), F.col("_html_links")
    navigation = mixes_navigation(F.col("source_url")) if "source_url" in records.columns else None
    groups = F.col("_html_groups")
    labelled = F.exists(groups, lambda g: g["label"].isNotNull())
    filled = (
        records.withColumn("_html_tags", page_tags(page.html))
        .withColumn("_html_links", tag_links(page))
        .withColumn("_html_groups", ingredient_groups(page, navigation))
        .withColumn("ingredients_raw", food_only(F.col("ingredients_raw")))
        .withColumn("keywords", prefer_list(F.col("keywords"), keywords(page, links)))
        .withColumn("category", prefer(F.col("category"), category(page)))
        .withColumn("cuisine", prefer(F.col("cuisine"), cuisine(page, links)))
        .withColumn("difficulty", prefer(F.col("difficulty"), difficulty(page, links)))
        .withColumn(
            "ingredient_groups",
            F.when((F.size("ingredients_raw") == 0) | labelled, groups).otherwise(F.col("ingredient_groups")),
        )
        .withColumn(
            "image_captions",
            F.transform(
                "image_urls",
                lambda _, i: F.coalesce(empty_to_null(F.get(F.col("image_captions"), i)), F.col("title")),
            ),
        )
    )
    return filled.drop("html", "_html_groups", "_html_tags", "_html_links")


