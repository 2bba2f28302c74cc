"""Durations, servings and time reconciliation as column expressions."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import empty_to_null, strip

# Accepted duration formats and limits.
ISO_DURATION = r"(?i)^PT?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
HOURS_TEXT = r"(?i)(\d+)\s*(?:h|Std|Stunden?)\.?"
MINUTES_TEXT = r"(?i)(\d+)\s*(?:min|Min|Minuten?)\.?"
LONG_TIME_TEXT = (
    r"(?i)(?:ca\.?\s*)?(?:(\d+)\s*(?:Std\.?|Stunden?|h(?:eures?)?))\s*"
    r"(?:(\d+)\s*(?:Min\.?|Minuten?|min(?:utes?)?))?"
    r"|(?:ca\.?\s*)?(\d+)\s*(?:Min\.?|Minuten?|min(?:utes?)?)"
)
MAX_MINUTES = 10_080
MAX_SMALLINT = 32_767


def utc_literal(moment: datetime) -> Column:
    """Zone-free timestamp literal in UTC; a moment without zone is taken as UTC already."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc)
    return F.expr(f"timestamp_ntz '{moment:%Y-%m-%d %H:%M:%S.%f}'")


def _number(text: Column, pattern: str, group: int) -> Column:
    return empty_to_null(F.regexp_extract(text, pattern, group)).try_cast("decimal(38,0)")


def _bounded(total: Column) -> Column:
    return F.when((total > 0) & (total <= MAX_MINUTES), total.cast("int"))


def text_minutes(text: Column) -> Column:
    """Minutes in texts such as ``1 h 35 min``, ``2 Std 10 min`` or ``ca. 30 Min.``; null when none."""
    hours = _number(text, HOURS_TEXT, 1)
    minutes = _number(text, MINUTES_TEXT, 1)
    zero = F.lit(0)
    return _bounded(F.coalesce(hours, zero) * 60 + F.coalesce(minutes, zero))


def duration_minutes(text: Column) -> Column:
    """Minutes of an ISO-8601 duration (30 seconds or more count as one), else of plain text."""
    iso = strip(text)
    zero = F.lit(0)
    seconds = F.coalesce(_number(iso, ISO_DURATION, 3), zero)
    total = (
        F.coalesce(_number(iso, ISO_DURATION, 1), zero) * 60
        + F.coalesce(_number(iso, ISO_DURATION, 2), zero)
        + F.when(seconds >= 30, 1).otherwise(0)
    )
    return F.when(iso.rlike(ISO_DURATION), _bounded(total)).otherwise(text_minutes(text))


def text_to_iso(text: Column) -> Column:
    """German or French duration text as ISO-8601, empty string when there is none."""
    hours = F.coalesce(_number(text, LONG_TIME_TEXT, 1), F.lit(0))
    only = F.coalesce(_number(text, LONG_TIME_TEXT, 3), F.lit(0))
    minutes = F.when(only > 0, only).otherwise(F.coalesce(_number(text, LONG_TIME_TEXT, 2), F.lit(0)))
    parts = F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
        F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""),
    )
    return F.coalesce(F.when(parts != "", F.concat(F.lit("PT"), parts)), F.lit(""))


def smallint_or_null(value: Column) -> Column:
    """The value when it fits a smallint, else null."""
    return F.when(value <= MAX_SMALLINT, value)


def servings(text: Column) -> Column:
    """First whole number in a yield text."""
    return empty_to_null(F.regexp_extract(text, r"(\d+)", 1)).try_cast("smallint")


class Times(NamedTuple):
    prep: Column
    cook: Column
    total: Column


def reconcile_times(prep: Column, cook: Column, total: Column) -> Times:
    """Settle preparation, cooking and total minutes.

    Equal prep and cook values mean that a source repeated one active time: the passive time is then
    what the total leaves over. A lone prep time is completed from the total in the same way.
    """
    repeated = prep.isNotNull() & cook.isNotNull() & (prep == cook)
    both = prep.isNotNull() & cook.isNotNull()
    only_prep = prep.isNotNull() & cook.isNull()
    passive = F.when(total > prep, total - prep)
    settled_cook = F.when(repeated | only_prep, passive).otherwise(cook)
    settled_total = (
        F.when(repeated | only_prep, F.coalesce(total, prep))
        .when(both, prep + cook)
        .otherwise(F.coalesce(cook, total))
    )
    return Times(smallint_or_null(prep), smallint_or_null(settled_cook), smallint_or_null(settled_total))


def own_total(prep: Column, cook: Column) -> Column:
    """Total of hand-entered times: the sum, or whichever is given."""
    return F.coalesce(prep + cook, prep, cook)
