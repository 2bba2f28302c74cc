"""Ingredient-name clean-up and match candidates as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.text import any_of, strip


def _fold(text: str) -> str:
    decomposed = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


_GERMAN = (
    f"(?:{any_of(_fold(stem) for stem in V.GERMAN_ADJECTIVE_STEMS)})(?:{any_of(V.GERMAN_ADJECTIVE_ENDINGS)})"
    f"|{any_of(_fold(word) for word in V.GERMAN_UNINFLECTED)}"
)
_FRENCH = any_of(_fold(word) for word in V.FRENCH_QUALIFIERS)
_GERMAN_LEADING = f"^(?:(?:{_GERMAN}) +|bio- *)+"
_GERMAN_TRAILING = f"(?: (?:{_GERMAN}))+$"
_FRENCH_LEADING = f"^(?:(?:{_FRENCH}) +)+"
_FRENCH_TRAILING = f"(?: (?:{_FRENCH}))+$"
_FRENCH_MEASURE = f"^(?:{any_of(V.FRENCH_MEASURE_PHRASES)}) *(?=[^ ])"
_FRENCH_ARTICLE = f"^(?:(?:{any_of(V.FRENCH_ARTICLES)}) +|(?:{any_of(V.FRENCH_ELIDED_ARTICLES)}) *)+"


def clean_name(raw: Column) -> Column:
    """Name without brackets, branding and preparation notes; null for bracketed alternatives."""
    text = strip(F.regexp_replace(raw, V.BRACKETS, ""))
    text = strip(F.regexp_replace(text, V.BRANDING, ""))
    # Cut at the first comma that is not a decimal comma.
    text = strip(F.regexp_replace(text, r"(?sU)(?:(?<!\d),|,(?!\d)).*$", ""))
    return F.when(~raw.rlike(V.ALTERNATIVE_NAME), text)


def without_prefix(text: Column, pattern: str) -> Column:
    """Drop a leading quantity."""
    return strip(F.regexp_replace(text, pattern, ""))


def lookup_texts(cleaned: Column, lowered: Column, without_unit: Column, without_count: Column) -> Column:
    """Texts to try in order: the name, without quantity and unit, without a bare count.

    The shortened ones only count when something was dropped and something is left.
    """

    def shortened(text: Column) -> Column:
        return F.when((text != "") & (text != lowered), text)

    return F.array(cleaned, shortened(without_unit), shortened(without_count))


def strip_german(text: Column) -> Column:
    """Drop German qualifiers at both ends, then purpose and weight tails."""
    bare = F.regexp_replace(F.regexp_replace(text, _GERMAN_LEADING, ""), _GERMAN_TRAILING, "")
    return F.rtrim(F.regexp_replace(F.rtrim(F.regexp_replace(bare, V.PURPOSE_TAIL, "")), V.WEIGHT_TAIL, ""))


def strip_french_context(text: Column) -> Column:
    """Drop a leading French measure phrase, then articles."""
    return F.regexp_replace(F.regexp_replace(text, _FRENCH_MEASURE, ""), _FRENCH_ARTICLE, "")


def strip_french(text: Column) -> Column:
    """Drop French qualifiers at both ends."""
    return F.regexp_replace(F.regexp_replace(text, _FRENCH_LEADING, ""), _FRENCH_TRAILING, "")


def _singulars(word: Column, endings: list[tuple[str, str, int]]) -> Column:
    """Array of shorter forms, one place per ``(ending, replacement, least remaining length)``."""
    rules = F.array(
        *[F.struct(F.lit(e).alias("end"), F.lit(r).alias("put"), F.lit(n).alias("rest")) for e, r, n in endings]
    )

    def shorter(rule: Column) -> Column:
        cut = F.length(word) - F.length(rule["end"])
        return F.when(
            F.endswith(word, rule["end"]) & (cut >= rule["rest"]), F.concat(F.substr(word, F.lit(1), cut), rule["put"])
        )

    return F.transform(rules, shorter)


def german_singulars(word: Column) -> Column:
    return _singulars(word, [(ending, "", 3) for ending in V.GERMAN_PLURAL_ENDINGS])


def french_singulars(word: Column) -> Column:
    return _singulars(word, [("s", "", 3), ("x", "", 3), ("aux", "al", 2)])


def match_candidates(text: Column, german: Column, context: Column, context_bare: Column, french: Column) -> Column:
    """Candidate names in order of preference, nulls removed.

    ``german``, ``context``, ``context_bare`` and ``french`` are the stripped variants of ``text``.
    The French-context variants only count when the context was really there, which keeps them
    ahead of the plain French ones.
    """
    in_context = context != text
    last = F.when(text.contains("-"), F.element_at(F.split(text, "-"), -1))
    none = F.array().cast("array<string>")
    ordered = F.concat(
        F.array(text, german),
        german_singulars(text),
        german_singulars(german),
        F.when(
            in_context,
            F.concat(F.array(context, context_bare), french_singulars(context), french_singulars(context_bare)),
        ).otherwise(none),
        F.array(french),
        french_singulars(french),
        french_singulars(text),
        F.array(last),
        F.coalesce(german_singulars(last), none),
    )
    return F.filter(ordered, lambda c: c.isNotNull() & (c != ""))
