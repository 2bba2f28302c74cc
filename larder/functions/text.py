"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

_LAST = 0x110000
_SURROGATES = range(0xD800, 0xE000)
# Below this most letters of Latin texts lie; only single characters are looked for there.
_LATIN = 0x0250
# Hangul syllables decompose by arithmetic: 19 leading and 21 middle letters, and 27 closing ones or none.
_HANGUL = range(0xAC00, 0xD7A4)
_LEADS, _VOWELS, _TAILS = (list(map(chr, range(low, low + n))) for low, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters that become one other (the first string, in pairs with the second) or none (the rest of the first), and those that become several."""
    source, target, removed, several = [], [], [], {}
    for code in range(_LAST):
        char = chr(code)
        if code in _SURROGATES or code in _HANGUL:
            continue
        folded = _fold(char)
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            several[char] = folded
        else:
            removed.append(char)
    return "".join(source + removed), "".join(target), several


def _ranges(codes: Sequence[int]) -> str:
    """A character class of the given code points."""
    out, low = [], None
    for k, code in enumerate(codes):
        low = code if low is None else low
        if k + 1 == len(codes) or codes[k + 1] != code + 1:
            out.append(rf"\x{{{low:X}}}-\x{{{code:X}}}")
            low = None
    return f"[{''.join(out)}]"


def _expanded(text: Column) -> Column:
    """Each character that decomposes to several replaced by these; those of one text are looked up once each."""
    several = _fold_tables()[2]
    names, values = "".join(several), F.split(F.lit("\x00".join(several.values())), "\x00")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_ranges(sorted(map(ord, several)))), 0))
    plain = F.aggregate(found, text, lambda acc, c: F.replace(acc, c, F.get(values, F.instr(F.lit(names), c) - 1)))

    def syllable(c: Column) -> Column:
        n = F.ascii(c) - _HANGUL.start
        letter = lambda letters, at: F.get(F.split(F.lit(",".join(letters)), ","), at.cast("int"))
        parts = F.concat(letter(_LEADS, F.floor(n / 588)), letter(_VOWELS, F.floor(n % 588 / 28)), letter(["", *_TAILS], n % 28))
        return F.when(n.between(0, len(_HANGUL) - 1), parts).otherwise(c)

    def without_syllables(t: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(t, F.lit("(?s)."), 0), syllable)
        return F.when(t.rlike(_ranges(_HANGUL)), F.array_join(parts, "")).otherwise(t)

    return let(plain, without_syllables)


def strip_accents(text: Column) -> Column:
    """Decompose by compatibility and drop combining marks, for all scripts (``Crème`` -> ``Creme``, ``ά`` -> ``α``)."""
    source, target, several = _fold_tables()
    low = [ord(c) for c in several if ord(c) < _LATIN]
    rare = text.rlike(_ranges([*low, *range(_LATIN, _LAST)]))
    return F.translate(F.when(rare, let(text, _expanded)).otherwise(text), source, target)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times.

    Keeps the expression small even after Spark pushes a filter on it towards the scan, which would
    otherwise copy every intermediate step into each of its uses.
    """
    return F.get(F.transform(F.array(value), use), 0)


def squeeze(text: Column) -> Column:
    """Collapse runs of whitespace to one blank and trim."""
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def strip(text: Column) -> Column:
    """Trim any Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def normalise_title(text: Column) -> Column:
    """Accent-free, lower-case, single-spaced text for matching."""
    return squeeze(F.lower(strip_accents(text)))


def tag_slug(text: Column) -> Column:
    """Lower-case slug of letters (incl. äöüéèà), digits and hyphens."""
    dashed = F.regexp_replace(F.lower(strip(text)), "[^a-z0-9äöüéèà-]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def empty_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def non_empty(items: Column) -> Column:
    """Trim every element and drop the empty ones."""
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def split_keywords(text: Column) -> Column:
    """Comma-separated keywords as a clean array."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(non_empty(F.split(text, ",")))


def content_hash(language: Column, title: Column, ingredients: Column, steps: Column) -> Column:
    """SHA-256 over language, title, ingredient lines and step lines, separated by the unit separator."""

    def lines(items: Column) -> Column:
        return F.coalesce(F.array_join(items, "\n"), F.lit(""))

    empty = F.lit("")
    return F.sha2(
        F.concat_ws(
            "\u001f", F.coalesce(language, empty), F.coalesce(title, empty), lines(ingredients), lines(steps)
        ),
        256,
    )


def mapped(value: Column, table: dict[str, object]) -> Column:
    """Look a value up in a small fixed table; null when absent."""
    entries = ", ".join(f"{_literal(x)}" for pair in table.items() for x in pair)
    return F.element_at(F.expr(f"map({entries})"), value)


def _literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def first_mapped(items: Column, table: dict[str, str]) -> Column:
    """First non-null lookup over an array, in array order."""
    hits = F.filter(F.transform(items, lambda x: mapped(x, table)), lambda x: x.isNotNull())
    return F.get(hits, 0)


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in the text."""
    listed = F.expr(f"array({', '.join(_literal(w) for w in words)})")
    return F.size(F.filter(listed, lambda w: F.contains(text, w)))


def any_of(words: Sequence[str]) -> str:
    """Regex alternation of literal words, longest first."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    return "|".join(_quote(w) for w in ordered)


def _quote(word: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in word)
