"""Classification columns: course, cuisine, difficulty, protein, taste, weight, method, diet, groups.

Row-level rules work on arrays that one page carries (keywords, steps, lines). Rules over resolved
ingredients first reduce the lines of a recipe to a handful of mergeable aggregates
(:func:`part_profile`), so that a recipe of any size is pre-aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.text import any_of, count_contained, empty_to_null, first_mapped, let, mapped, strip
from larder.functions.urls import slug_words
from larder.plans.joins import join_dimension, lookup_distinct

_PROTEINS = list(V.PROTEIN_KEYWORDS)
_CATALOGUE_PROTEINS = sorted(set(V.PROTEIN_OF_SUB_CATEGORY.values()))


def _key(text: Column) -> Column:
    return F.lower(strip(text))


def _keys(items: Column) -> Column:
    return F.transform(items, _key)


def _first_pattern(text: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    result = None
    for value, pattern in patterns:
        hit = text.rlike(f"(?iU)(?:{pattern})")
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def title_course(title: Column) -> Column:
    return _first_pattern(title, V.COURSE_TITLE_PATTERNS)


def course(category: Column, title: Column, keywords: Column, from_title: Column | None = None) -> Column:
    """Explicit category, else course words in the keywords, title patterns (``from_title``: their result), food keywords."""
    return F.coalesce(
        mapped(_key(category), V.COURSES),
        first_mapped(_keys(keywords), V.COURSES),
        title_course(title) if from_title is None else from_title,
        first_mapped(_keys(keywords), V.COURSE_FOOD_KEYWORDS),
    )


def explicit_cuisine(raw: Column) -> Column:
    """Lower-case cuisine with synonyms mapped; null for lists of categories and other non-cuisines."""
    value = empty_to_null(_key(raw))
    usable = ~value.contains(",") & ~value.isin(V.NOT_A_CUISINE)
    return F.when(usable, F.coalesce(mapped(value, V.CUISINE_SYNONYMS), value))


def cuisine_from_url(url: Column) -> Column:
    return let(slug_words(url), lambda slug: _first_pattern(slug, V.CUISINE_URL_PATTERNS))


def cuisine_from_lines(lines: Column) -> Column:
    """First cuisine of which enough distinctive ingredients occur in the lines of one record."""

    def first(text: Column) -> Column:
        result = None
        for value, words in V.CUISINE_INGREDIENTS:
            hit = count_contained(text, words) >= V.CUISINE_MIN_INGREDIENTS
            result = F.when(hit, value) if result is None else result.when(hit, value)
        return result

    return let(F.array_join(F.transform(lines, F.lower), " "), first)


def named_cuisine(text: Column) -> Column:
    return _first_pattern(text, V.CUISINE_PATTERNS)


def cuisine(
    raw: Column, title: Column, keywords: Column, url: Column, lines: Column | None = None,
    from_title: Column | None = None, from_keywords: Column | None = None,
) -> Column:
    """Explicit value, else title, keywords, URL slug and ingredient combinations, in that order.

    ``from_title`` and ``from_keywords`` hand over what :func:`named_cuisine` says of the title and of the joined keywords.
    """
    layers = [
        explicit_cuisine(raw),
        named_cuisine(title) if from_title is None else from_title,
        let(F.array_join(keywords, " "), named_cuisine) if from_keywords is None else from_keywords,
        cuisine_from_url(url),
    ]
    if lines is not None:
        layers.append(cuisine_from_lines(lines))
    return F.coalesce(*layers)


def difficulty(raw: Column, total_minutes: Column) -> Column:
    """Explicit level, else by total time."""
    return F.coalesce(
        mapped(_key(raw), V.DIFFICULTIES),
        F.when(total_minutes <= V.EASY_MINUTES, "easy")
        .when(total_minutes <= V.MEDIUM_MINUTES, "medium")
        .when(total_minutes.isNotNull(), "advanced"),
    )


def classification(df: DataFrame) -> DataFrame:
    """Add ``course, cuisine, difficulty`` to raw records; difficulty falls back to the keywords."""
    keywords = F.coalesce("keywords", F.array().cast("array<string>"))
    return df.select(
        "*",
        course(F.col("category"), F.col("title"), keywords).alias("_course"),
        cuisine(F.col("cuisine"), F.col("title"), keywords, F.col("source_url")).alias("_cuisine"),
        F.coalesce(
            difficulty(F.col("difficulty"), F.lit(None).cast("int")), first_mapped(_keys(keywords), V.DIFFICULTIES)
        ).alias("_difficulty"),
    ).select(
        *[c for c in df.columns if c not in ("course", "cuisine", "difficulty")],
        F.col("_course").alias("course"),
        F.col("_cuisine").alias("cuisine"),
        F.col("_difficulty").alias("difficulty"),
    )


def method_text(steps: Column, keywords: Column) -> Column:
    """Steps and keywords as the one text that methods are looked for in."""
    return F.concat(
        F.lower(F.array_join(F.coalesce(steps, F.array().cast("array<string>")), " ")),
        F.lit(" "),
        F.lower(F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), " ")),
    )


def method_of(text: Column) -> Column:
    """Method with the most of its patterns present in a text of :func:`method_text`."""
    scores = [
        F.struct(
            count_contained(text, patterns).alias("n"), F.lit(-place).alias("place"), F.lit(method).alias("method")
        )
        for place, (method, patterns) in enumerate(V.METHOD_PATTERNS.items())
    ]
    return let(F.array_max(F.array(*scores)), lambda top: F.when(top["n"] > 0, top["method"]))


def cooking_method(steps: Column, keywords: Column) -> Column:
    """Method with the most of its patterns present in steps and keywords."""
    return let(method_text(steps, keywords), method_of)


def tokens(text: Column) -> Column:
    """Lower-case blank-separated words without closing punctuation."""
    words = F.split(strip(F.lower(F.coalesce(text, F.lit("")))), r"(?U)[\s\x1c-\x1f]+")
    return F.transform(words, lambda w: F.regexp_replace(w, V.TOKEN_TAIL, ""))


def _compound_pattern(words: Sequence[str]) -> str:
    long = [w for w in words if len(w) >= V.COMPOUND_MIN_LENGTH]
    return f"^(?:{any_of(long)})|(?:{any_of([w for w in long if w not in V.CUT_WORDS])})$"


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Does any word of the text, or a part of a hyphenated word, equal or compound one of ``words``?"""
    compound = _compound_pattern(words)
    exact = list(words)
    return F.exists(
        tokens(text),
        lambda t: t.isin(exact)
        | F.exists(F.split(t, "-"), lambda part: part.isin(exact) | part.rlike(compound)),
    )


def protein_bits(text: Column) -> Column:
    """Bit set of protein kinds that the words of a text name (bit i is the i-th kind)."""

    def bit(token: Column) -> Column:
        exact = compound = None
        for place, words in enumerate(V.PROTEIN_KEYWORDS.values()):
            value = F.lit(1 << place).cast("bigint")
            same, part = token.isin(words), token.rlike(_compound_pattern(words))
            exact = F.when(same, value) if exact is None else exact.when(same, value)
            compound = F.when(part, value) if compound is None else compound.when(part, value)
        return F.coalesce(exact, compound, F.lit(0).cast("bigint"))

    return F.aggregate(tokens(text), F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseOR(bit(t)))


def catalogue_traits(catalogue: DataFrame) -> DataFrame:
    """Per catalogue entry what the recipe rules need to know about it."""
    sub = F.col("sub_category")
    tags = F.coalesce("pairing_tags", F.array().cast("array<string>"))
    group_bits = sum(
        (
            F.when(F.array_contains(tags, group), F.lit(1 << place).cast("bigint")).otherwise(0)
            for place, group in enumerate(V.FOOD_GROUPS)
        ),
        F.lit(0).cast("bigint"),
    )
    animal = F.col("category").isin("meat", "fish")
    return catalogue.select(
        F.col("id").alias("ingredient_id"),
        F.lit(True).alias("known"),
        animal.alias("animal"),
        (F.col("category") == "dairy").alias("dairy"),
        F.col("category").isin("meat", "fish", "vegetable").alias("savoury"),
        F.col("key").isin(V.SWEET_INGREDIENTS).alias("sweet"),
        ((F.col("category") == "dairy") & F.coalesce(sub.isin(V.HEAVY_DAIRY), F.lit(False))).alias("heavy_dairy"),
        mentions(F.col("display_de"), [*V.MEAT_WORDS, *V.FISH_WORDS]).alias("animal_name"),
        F.when(animal, mapped(sub, V.PROTEIN_OF_SUB_CATEGORY)).alias("protein"),
        group_bits.alias("group_bits"),
    )


def _text_facts(texts: DataFrame) -> DataFrame:
    text = F.col("_open_text")
    facts = F.struct(protein_bits(text).alias("bits"), mentions(text, [*V.MEAT_WORDS, *V.FISH_WORDS]).alias("animal"))
    return texts.withColumn("_facts", F.when(text.isNotNull(), facts)).select(*texts.columns, F.col("_facts.bits").alias("_bits"), F.col("_facts.animal").alias("_animal"))


def part_profile(lines: DataFrame, catalogue: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """One row per recipe with the mergeable facts about its ingredient lines."""
    joined = join_dimension(lines, catalogue_traits(catalogue), "ingredient_id", "left")
    # Words of the text are only read for lines that no catalogue entry explains, and once per distinct text.
    joined = lookup_distinct(joined.withColumn("_open_text", F.when(F.col("ingredient_id").isNull(), F.col("raw_text"))), "_open_text", _text_facts)
    bits, animal_text = F.coalesce("_bits", F.lit(0).cast("bigint")), F.coalesce("_animal", F.lit(False))

    def any_(flag: str) -> Column:
        return F.coalesce(F.bool_or(flag), F.lit(False))

    weights = [
        F.sum(F.when(F.col("protein") == p, F.coalesce("quantity", F.lit(0.0)))).alias(f"w_{p}")
        for p in _CATALOGUE_PROTEINS
    ]
    return (
        joined.withColumn("text_bits", bits)
        .withColumn("animal_text", animal_text)
        .groupBy(recipe)
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count("known").alias("n_known"),
            F.count_if("sweet").alias("n_sweet"),
            any_("animal").alias("animal"),
            any_("dairy").alias("dairy"),
            any_("savoury").alias("savoury"),
            any_("heavy_dairy").alias("heavy_dairy"),
            any_("animal_name").alias("animal_name"),
            any_("animal_text").alias("animal_text"),
            F.bit_or("text_bits").alias("text_bits"),
            F.coalesce(F.bit_or("group_bits"), F.lit(0).cast("bigint")).alias("group_bits"),
            *weights,
        )
    )


def primary_protein() -> Column:
    """Dominant protein from a part profile: by kind, by weight, else ``mixed``."""
    from_text = F.when(F.bit_count("text_bits") > 1, "mixed")
    for place, kind in enumerate(_PROTEINS):
        from_text = from_text.when(F.col("text_bits") == (1 << place), kind)
    weights = F.filter(
        F.array(*[F.struct(F.col(f"w_{p}").alias("w"), F.lit(p).alias("kind")) for p in _CATALOGUE_PROTEINS]),
        lambda x: x["w"].isNotNull(),
    )
    ranked = F.sort_array(weights, asc=False)
    first, second = F.get(ranked, 0), F.get(ranked, 1)
    from_parts = F.when(F.size(ranked) == 1, first["kind"]).when(
        F.size(ranked) > 1, F.when(first["w"] > 2 * second["w"], first["kind"]).otherwise("mixed")
    )
    return F.when(F.coalesce("animal", F.lit(False)), from_parts).otherwise(from_text)


def _has_keyword(keywords: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.exists(keywords, lambda k: F.lower(k).isin(list(words))), F.lit(False))


def taste_profile(course_: Column, keywords: Column) -> Column:
    """Sweet, savoury or sweet-savoury, from course, keywords and a part profile."""
    known = F.coalesce("n_known", F.lit(0))
    sweet = F.coalesce("n_sweet", F.lit(0))
    return (
        F.when(F.coalesce(course_.isin(V.SWEET_COURSES), F.lit(False)), "sweet")
        .when(
            _has_keyword(keywords, V.SWEET_KEYWORDS),
            F.when(F.coalesce("savoury", F.lit(False)), "sweet-savoury").otherwise("sweet"),
        )
        .when((sweet > 0) & (sweet >= known * F.lit(V.SWEET_SHARE)), "sweet")
        .otherwise("savoury")
    )


def _signals(*flags: Column) -> Column:
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))


def weight_class(course_: Column, cook_minutes: Column, keywords: Column, protein: Column) -> Column:
    """Light, medium or heavy: two heavy signals win over two light ones."""
    heavy = _signals(
        cook_minutes > V.HEAVY_COOK_MINUTES,
        protein.isin(V.HEAVY_PROTEINS),
        F.col("heavy_dairy"),
        _has_keyword(keywords, V.HEAVY_KEYWORDS),
    )
    light = _signals(
        protein.isNull(), cook_minutes <= V.LIGHT_COOK_MINUTES, _has_keyword(keywords, V.LIGHT_KEYWORDS)
    )
    return (
        F.when(F.coalesce(course_.isin(V.LIGHT_COURSES), F.lit(False)), "light")
        .when(heavy >= 2, "heavy")
        .when(light >= 2, "light")
        .otherwise("medium")
    )


def dietary_flags(total_minutes: Column) -> Column:
    """Sorted flags from a part profile; nothing is claimed when no line could be resolved."""
    undecided = (F.coalesce("n_lines", F.lit(0)) > 0) & (F.coalesce("n_known", F.lit(0)) == 0)
    false = F.lit(False)
    animal = F.coalesce("animal", false) | F.coalesce("animal_name", false) | F.coalesce("animal_text", false)
    dairy = F.coalesce("dairy", false)
    return F.array_compact(
        F.array(
            F.when(~undecided & ~dairy, "dairy-free"),
            F.when(total_minutes <= V.QUICK_MINUTES, "quick"),
            F.when(~undecided & ~animal & ~dairy, "vegan"),
            F.when(~undecided & ~animal, "vegetarian"),
        )
    )


def food_groups() -> Column:
    """Sorted food groups that the tags of the resolved parts name."""
    bits = F.coalesce("group_bits", F.lit(0).cast("bigint"))
    named = [F.when(bits.bitwiseAND(1 << place) != 0, group) for place, group in enumerate(V.FOOD_GROUPS)]
    return F.array_sort(F.array_compact(F.array(*named)))


COMPUTED_SCALARS = [
    "primary_protein", "taste_profile", "weight_class", "cooking_method", "course", "cuisine", "difficulty",
]


def computed_tags(
    scalars: Sequence[str] = tuple(COMPUTED_SCALARS), arrays: Sequence[str] = ("dietary_flags", "food_groups")
) -> Column:
    """One sorted, distinct array of every classification value of a recipe."""
    empty = F.array().cast("array<string>")
    bag = F.concat(F.array(*scalars), *[F.coalesce(a, empty) for a in arrays])
    return F.array_sort(F.array_distinct(F.filter(bag, lambda x: x.isNotNull() & (x != ""))))


def classify_parts(
    recipes: DataFrame, lines: DataFrame, catalogue: DataFrame, recipe: str = "recipe_id"
) -> DataFrame:
    """Add ``primary_protein, taste_profile, weight_class, dietary_flags, food_groups`` to recipes.

    ``recipes`` carries ``course, cook_minutes, total_minutes, keywords``.
    """
    keep = recipes.columns
    profiled = recipes.join(part_profile(lines, catalogue, recipe), recipe, "left").withColumn(
        "primary_protein", primary_protein()
    )
    return profiled.select(
        *keep,
        "primary_protein",
        taste_profile(F.col("course"), F.col("keywords")).alias("taste_profile"),
        weight_class(
            F.col("course"), F.col("cook_minutes"), F.col("keywords"), F.col("primary_protein")
        ).alias("weight_class"),
        dietary_flags(F.col("total_minutes")).alias("dietary_flags"),
        food_groups().alias("food_groups"),
    )
