"""Ingredient lines to quantity, unit, name and note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import vocabulary as V
from larder.functions.text import empty_to_null, let, mapped, strip

_APART = "\uffff"


def parse_lines(df: DataFrame, line: str = "raw_text") -> DataFrame:
    """Add ``quantity, unit, ingredient, prep_note, optional`` parsed from a text column.

    Blank lines get nulls and ``optional = false``. The end of a range is read and dropped, so
    ``2-3 Eier`` has quantity 2.
    """
    keep = [c for c in df.columns if c not in PARSED]
    return df.withColumn("_parsed", parsed_line(F.col(line))).select(*keep, *[f"_parsed.{c}" for c in PARSED])


PARSED = ["quantity", "unit", "ingredient", "prep_note", "optional"]


def parsed_line(line: Column) -> Column:
    """Struct of the parts of one ingredient line."""
    return let(strip(line), lambda text: let(F.coalesce(text.rlike(V.OPTIONAL_MARKER), F.lit(False)), lambda optional: (
        let(_body(text, optional), lambda body: _fields(body, optional))
    )))


def _body(text: Column, optional: Column) -> Column:
    """Line without optional marker and vague quantity words; null when nothing is left."""
    plain = strip(F.regexp_replace(text, V.OPTIONAL_MARKER, ""))
    plain = F.regexp_replace(plain, r"(?U)^[:,]\s*", "")
    plain = F.regexp_replace(plain, r"(?U)\s*[:,]\s*$", "")
    plain = strip(F.regexp_replace(plain, r"(?U)\s{2,}", " "))
    return empty_to_null(F.regexp_replace(F.when(optional, plain).otherwise(text), V.VAGUE_QUANTITY, ""))


def _fields(body: Column, optional: Column) -> Column:
    """Fields of a line; a body the quantity pattern does not fit is the ingredient as it stands."""

    def build(quantity: Column, unit: Column, ingredient: Column, note: Column) -> Column:
        return F.struct(
            quantity.alias("quantity"),
            unit.alias("unit"),
            ingredient.alias("ingredient"),
            note.alias("prep_note"),
            optional.alias("optional"),
        )

    def measured(parts: Column) -> Column:
        return let(_measure(parts[2]), lambda m: let(_name_and_note(m["name"]), lambda n: build(
            _quantity(parts[0], parts[1]), m["unit"], n["name"], n["note"]
        )))

    none = F.lit(None).cast("string")
    # One pass of the pattern puts number, fraction and rest apart; the separator is no character.
    pieces = F.split(F.regexp_replace(body, V.QUANTITY, f"$1{_APART}$2{_APART}$4"), _APART, 3)
    return let(pieces, lambda parts: F.when(F.size(parts) == 3, measured(parts)).otherwise(
        build(F.lit(None).cast("double"), none, body, none)
    ))


def _quantity(amount: Column, fraction: Column) -> Column:
    """Number plus fraction; null when there is neither, or when they add up to zero."""
    number = F.replace(amount, F.lit(","), F.lit(".")).try_cast("double")
    part = mapped(fraction, V.FRACTIONS)
    return let(
        F.coalesce(number, F.lit(0.0)) + F.coalesce(part, F.lit(0.0)), lambda value: F.when(value > 0, value)
    )


def _measure(text: Column) -> Column:
    """Unit at the start of a text and what follows it: a French spoon unit, else the first word."""

    def parts(rest: Column, spoon: Column, word: Column, unit: Column) -> Column:
        after = F.when(spoon != "", F.substr(rest, F.length(spoon) + 1)).when(
            unit.isNotNull(), F.substr(rest, F.length(word) + 1)
        )
        spoon_unit = F.when(spoon.rlike(V.TABLE_SPOON_END), "EL").otherwise("TL")
        name = strip(F.regexp_replace(strip(after), V.FRENCH_PREPOSITION, ""))
        return F.struct(
            F.when(spoon != "", spoon_unit).otherwise(unit).alias("unit"), F.coalesce(name, rest).alias("name")
        )

    return let(text, lambda rest: let(F.regexp_extract(rest, V.SPOON_UNIT, 0), lambda spoon: (
        let(F.regexp_extract(rest, r"(?U)^(\S+)", 1), lambda word: (
            let(mapped(F.lower(F.rtrim(word, F.lit("."))), V.UNITS), lambda unit: parts(rest, spoon, word, unit))
        ))
    )))


def _name_and_note(text: Column) -> Column:
    """Name and note, apart by brackets at the end, else by the first comma."""
    comma = F.instr(text, F.lit(","))
    bracket = F.endswith(text, F.lit(")")) & text.rlike(V.BRACKET_NOTE)
    name = (
        F.when(bracket, strip(F.regexp_extract(text, V.BRACKET_NOTE, 1)))
        .when(comma > 0, strip(F.substr(text, F.lit(1), comma - 1)))
        .otherwise(text)
    )
    note = F.when(bracket, strip(F.regexp_extract(text, V.BRACKET_NOTE, 2))).when(
        comma > 0, strip(F.substr(text, comma + 1))
    )
    return F.struct(name.alias("name"), empty_to_null(note).alias("note"))
